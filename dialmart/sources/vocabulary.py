"""Vocabularies: rubrics, operation codes, units and topics, checked and turned into small tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(path: str) -> dict:
    """A vocabulary file: JSON, or YAML where its reader is installed."""
    body = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(body)
    return json.loads(body)


def rubric(dims: Sequence[Mapping]) -> tuple[dict[str, float], list[str]]:
    """Weights and gates of dimensions (id, weight, gate); the weights add up to 1 and one gate at least is there."""
    weights = {d["id"]: float(d["weight"]) for d in dims}
    gates = [d["id"] for d in dims if d.get("gate")]
    if len(weights) != len(dims) or abs(sum(weights.values()) - 1) > 1e-9 or not gates:
        raise ValueError("a rubric has distinct dimensions, weights that add up to 1, and a gate")
    return weights, gates


def code_kinds(spark: SparkSession, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """code and kind, one row for each code; a code of two kinds is an error."""
    rows = [(str(c).lstrip("0") or "0", kind) for kind, codes in kinds.items() for c in codes]
    twice = {c for c, _ in rows if sum(c == d for d, _ in rows) > 1}
    if twice:
        raise ValueError(f"codes of two kinds: {sorted(twice)}")
    return spark.createDataFrame(rows, "code string, kind string")


def unit_class(unit: Column, own: Column, center: Sequence[str], back: Sequence[str]) -> Column:
    """center, back, own or other, whatever zeros lead the codes."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^0+(?=.)", "")
    named = lambda codes: [str(c).lstrip("0") or "0" for c in codes]
    u = bare(unit)
    return (
        F.when(u.isin(named(center)), "center")
        .when(u.isin(named(back)), "back")
        .when(u == bare(own), "own")
        .otherwise("other")
    )
