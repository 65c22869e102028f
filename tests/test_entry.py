import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_topk" in e.queries()


def test_imports_without_the_optional_parts(tmp_path):
    code = """
import importlib.util as u
real = u.find_spec
u.find_spec = lambda name, *a: None if name in ("termloom.llm", "corpus_pipeline") else real(name, *a)
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not [n for n in e.queries() if n.startswith("op") and n[2].isdigit()] and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
