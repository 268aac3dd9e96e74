"""Columns that travel through an operator under names of their own, so that no name can clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def carried(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[T.StructField]]:
    """``docs`` as ``(doc_id long, text, k_0, k_1 ...)``, k_i being the columns ``names``, and the fields of those."""
    at = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    rows = plain.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text"), *(F.col(at[c]).alias(f"k_{i}") for i, c in enumerate(names)))
    return rows, [T.StructField(f"k_{i}", plain.schema[at[c]].dataType) for i, c in enumerate(names)]


def schema(results: str, fields: Sequence[T.StructField]) -> T.StructType:
    """The fields of a schema string, and then ``fields``."""
    return T.StructType([*T.StructType.fromDDL(results), *fields])


def returned(rows: DataFrame, results: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The columns ``results`` of rows and then k_0, k_1 ... under their old names."""
    return rows.select(*results, *(f"k_{i}" for i in range(len(names)))).toDF(*results, *names)


def clash(results: Sequence[str], keep: Sequence[str]) -> None:
    """Raise for columns to keep that are named like results (Spark's names know no case)."""
    if found := {c.lower() for c in keep} & {c.lower() for c in results}:
        raise ValueError(f"columns named like those of the result: {sorted(found)}")
