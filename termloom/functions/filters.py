"""Metadata filters over a JSON payload, as one predicate Column.

A clause is ``{"field": name, op: value, ...}`` with the operators eq, neq, in, lt, lte, gt, gte and
exists; all operators of all clauses must hold.  A field that is absent, or whose payload isn't JSON,
fails eq, in and the ranges, passes neq, and does not exist; an explicit null likewise, but ``in`` may
list None to match it.  Numbers compare by value and other scalars by type and value, so 12 isn't "12".
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "neq", "in", "lt", "lte", "gt", "gte", "exists")


class JsonField:
    """A top-level field of a payload, or a numeric column where the payload lacks it."""

    def __init__(self, payload: Column | None, name: str, rank: Column | None = None):
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        value = F.try_variant_get(F.try_parse_json(payload), path, "variant") if payload is not None else None
        fallback = rank.cast("double") if rank is not None else F.lit(None).cast("double")
        if value is None:
            self.absent, self.null = fallback.isNull(), F.lit(False)
            self.number, self.string, self.boolean = fallback, F.lit(None).cast("string"), F.lit(None).cast("boolean")
            return
        kind = F.schema_of_variant(value)
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
        self.absent = value.isNull() & fallback.isNull()
        self.null = F.coalesce(F.is_variant_null(value), F.lit(False))
        self.number = F.when(value.isNull(), fallback).when(numeric, F.try_variant_get(value, "$", "double"))
        self.string = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        self.boolean = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))

    def equals(self, want: object) -> Column:
        if want is None:
            return self.null
        if isinstance(want, bool):
            return F.coalesce(self.boolean == F.lit(want), F.lit(False))
        if isinstance(want, int | float):
            return F.coalesce(self.number == F.lit(float(want)), F.lit(False))
        return F.coalesce(self.string == F.lit(str(want)), F.lit(False))


def predicate(clauses: Sequence[Mapping], payload: Column | None = None, ranks: Mapping[str, Column] | None = None) -> Column:
    """Whether a row passes every clause.  ``ranks``: numeric columns that stand in for absent fields."""
    out = F.lit(True)
    for clause in clauses:
        unknown = set(clause) - {"field", *OPERATORS}
        if "field" not in clause or unknown:
            raise ValueError(f"a clause needs a field and the operators {', '.join(OPERATORS)}; got {dict(clause)}")
        f = JsonField(payload, clause["field"], (ranks or {}).get(clause["field"]))
        if clause.get("exists") is not None:
            there = ~f.absent & ~f.null
            out = out & (there if clause["exists"] else ~there)
        for op, test in (("lt", lambda n, v: n < v), ("lte", lambda n, v: n <= v), ("gt", lambda n, v: n > v), ("gte", lambda n, v: n >= v)):
            if clause.get(op) is not None:
                out = out & F.coalesce(test(f.number, F.lit(float(clause[op]))), F.lit(False))
        if clause.get("eq") is not None:
            out = out & f.equals(clause["eq"])
        if clause.get("neq") is not None:
            out = out & ~f.equals(clause["neq"])
        if clause.get("in") is not None:
            any_of = F.lit(False)
            for want in clause["in"]:
                any_of = any_of | f.equals(want)
            out = out & any_of
    return out
