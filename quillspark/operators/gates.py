"""Declared gates: rules as rows, evaluated on JSON documents, and their aggregate."""

from __future__ import annotations

import json
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_COMPARE = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
_ASSERTION = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(==|!=|>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*$")


def assertion(text: str, json: Column) -> Column:
    """A numeric assertion `path op number` on a JSON text; false where the path is missing or no number. ValueError for any other text."""
    found = _ASSERTION.match(text)
    if not found:
        raise ValueError(f"not an assertion: {text!r}")
    path, op, value = found.groups()
    return F.coalesce(_COMPARE[op](F.get_json_object(json, f"$.{path}").try_cast("double"), F.lit(float(value))), F.lit(False))


def gate_results(rows: DataFrame, json: str, gates: dict[str, str]) -> DataFrame:
    """gate, rows, passed, all_pass of every declared gate in one scan; no rows never pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(assertion(text, F.col(json))).alias(f"passed_{i}") for i, text in enumerate(gates.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), F.col("rows"), F.col(f"passed_{i}").alias("passed")) for i, name in enumerate(gates)]))
    return counts.select(each.alias("g")).select("g.gate", "g.rows", "g.passed", ((F.col("g.rows") > 0) & (F.col("g.rows") == F.col("g.passed"))).alias("all_pass"))


def rule_states(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, state: the worst severity found of each rule, clean without any. Rules are a declared vocabulary."""
    rank = F.when(F.col("severity") == "HARD", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    worst = findings.groupBy(F.col("code").alias("rule")).agg(F.min(rank).alias("rank"))
    state = F.when(F.col("rank") == 0, "hard").when(F.col("rank") == 1, "warn").when(F.col("rank") == 2, "skipped").otherwise("clean")
    return rules.join(worst, "rule", "left").select("rule", state.alias("state"))


def _once(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key stands twice")
    return dict(pairs)


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no number")


def canonical(text: str | None) -> str | None:
    """A JSON text with sorted keys and no white space; null for null, for what is no JSON, for a key that stands twice and for NaN or an infinity."""
    try:
        return json.dumps(json.loads(text, object_pairs_hook=_once, parse_constant=_refused), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """canonical() of each text."""
    return texts.map(canonical)


def canonical_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, canonical, digest of JSON texts, which are equal for equal values whatever their order and spaces."""
    made = rows.select(key, canonical_json(text).alias("canonical"))
    return made.select(key, "canonical", F.sha2("canonical", 256).alias("digest"))
