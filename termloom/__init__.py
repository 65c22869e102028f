"""Full-text retrieval and text analytics as Spark DataFrames."""
