"""Readers of corpora, queries, judgements, dictionaries and vectors."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, v) of the lines that aren't blank; one that isn't a JSON object stops the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    sound = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    checked = F.when(sound, v).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))
    return lines.select(F.col("value").alias("line"), checked.alias("v"))


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def read_jsonl(spark: SparkSession, path: str, title: bool = False) -> DataFrame:
    """(doc_id, text[, title], payload) of a file of JSON objects ``{id | _id, text | body, ...}``.

    ``text`` wins over ``body``; numbers serve as ids; blank lines are passed over.  A line that is no
    JSON object, or has no id, stops the job.  ``payload`` is the object as compact JSON.
    """
    doc_id = F.coalesce(_get("id"), _get("_id"))
    doc_id = F.when(doc_id.isNotNull(), doc_id).otherwise(F.raise_error(F.concat(F.lit("a line has no id: "), F.substring("line", 1, 80))))
    extra = [F.coalesce(_get("title"), F.lit("")).alias("title")] if title else []
    text = F.coalesce(_get("text"), _get("body"), F.lit(""))
    return _lines(spark, path).select(doc_id.alias("doc_id"), text.alias("text"), *extra, F.to_json("v").alias("payload"))


def read_beir(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_jsonl``, with titles."""
    return read_jsonl(spark, path, title=True)


def with_payload(df: DataFrame) -> DataFrame:
    """A table with ``payload``: every column but doc_id and text as one JSON object."""
    names = [c for c in df.columns if c not in ("doc_id", "text", "payload")]
    return df.withColumn("payload", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def rank_field(payload: Column, name: str) -> Column:
    """A payload's field as a number: booleans are 0 or 1, numeric strings are parsed, anything else is 0."""
    v = F.try_variant_get(F.try_parse_json(payload), f"$['{name}']", "variant")
    boolean = F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    text = F.try_variant_get(v, "$", "string").try_cast("double")
    return F.coalesce(boolean, F.when(~F.isnan(text), text), F.lit(0.0))


def column_name(field: str) -> str:
    """A field's name with ``_`` for whatever isn't a letter or digit."""
    return "".join(c if c.isalnum() else "_" for c in field)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id), one on a line, trimmed; blank lines are passed over."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word): lower-cased words of ASCII letters, digits, ``-`` and ``'``."""
    return dictionary(spark.read.text(path))


def dictionary(lines: DataFrame) -> DataFrame:
    """(word) of a table of lines (value), each word once."""
    words = lines.select(F.lower(F.trim("value")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z0-9'-]+$")).distinct()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of JSON lines ``{_id, text}``."""
    return _lines(spark, path).select(F.coalesce(_get("_id"), _get("id")).alias("qid"), F.coalesce(_get("text"), F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, grade) of tab-separated judgements under a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="qid string, doc_id string, grade int")
    return rows


def read_vectors(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(vec_id, embedding) of a Parquet table, or of a .safetensors file's ``embeddings`` or ``0`` (F32, F16, I8).

    ``rows``, if given, is the size of the vocabulary, which the file must match.
    """
    if not path.endswith(".safetensors"):
        return spark.read.parquet(path).select("vec_id", "embedding")
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        head = json.loads(f.read(n))
        name = next((x for x in ("embeddings", "0") if x in head), None)
        if name is None or len(head[name]["shape"]) != 2:
            raise ValueError("the file has no two-dimensional table of embeddings")
        kind = {"F32": np.float32, "F16": np.float16, "I8": np.int8}[head[name]["dtype"]]
        lo, hi = head[name]["data_offsets"]
        if rows is not None and head[name]["shape"][0] != rows:
            raise ValueError(f"the file has {head[name]['shape'][0]} embeddings for a vocabulary of {rows}")
        f.seek(8 + n + lo)
        table = np.frombuffer(f.read(hi - lo), kind).reshape(head[name]["shape"]).astype(np.float32)
    import pyarrow as pa

    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel()))
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(table))), "embedding": flat}))
