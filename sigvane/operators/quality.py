"""Data-quality checks.  A check yields rows (check, severity, key, detail); strict callers raise on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``failed`` is true on offending rows."""

    name: str
    failed: Column
    detail: Column
    severity: str = "error"


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")


def require_any_column(df: DataFrame, choices: Sequence[str], what: str) -> None:
    if not any(c in df.columns for c in choices):
        raise ValueError(f"{what} has none of the columns {', '.join(choices)}")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def row_violations(df: DataFrame, checks: Sequence[Check], key: Column) -> DataFrame:
    """All row checks in one scan; rows that fail none are dropped by a plain filter before their checks are listed."""
    suspect = F.lit(False)
    for c in checks:
        suspect = suspect | F.coalesce(c.failed, F.lit(False))
    found = F.array(
        *[
            F.when(
                F.coalesce(c.failed, F.lit(False)),
                F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), _text(key).alias("key"), _text(c.detail).alias("detail")),
            )
            for c in checks
        ]
    )
    return df.where(suspect).select(F.explode(F.filter(found, lambda v: v.isNotNull())).alias("_v")).select("_v.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str], ignore_nulls: bool = False) -> DataFrame:
    """Key combinations on more than one row with their count; nulls equal each other unless ignored."""
    rows = df
    if ignore_nulls:
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_violations(df: DataFrame, name: str, keys: Sequence[str], ignore_nulls: bool = False) -> DataFrame:
    found = duplicate_keys(df, keys, ignore_nulls)
    return found.select(
        F.lit(name).alias("check"),
        F.lit("error").alias("severity"),
        F.concat_ws("|", *[_text(F.col(k)) for k in keys]).alias("key"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"),
    )


def union_violations(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def raise_on(violations: DataFrame, what: str, shown: int = 20) -> None:
    """Raise when there is any error row, quoting the first few.

    They are gathered by one job over all partitions; ``take`` would try one, then four, and so on, where there is none to find.
    """
    some = violations.where(F.col("severity") == "error").limit(shown)
    errors = some.agg(F.collect_list(F.struct(*violations.columns)).alias("errors")).first()["errors"]
    if errors:
        listed = "; ".join(f"{v['check']} [{v['key']}] {v['detail']}" for v in errors)
        raise ValueError(f"{what}: {listed}")


@dataclass(frozen=True)
class Checked:
    """Normalized rows with the violations found in them."""

    rows: DataFrame
    violations: DataFrame

    def strict(self, what: str = "invalid input") -> DataFrame:
        raise_on(self.violations, what)
        return self.rows


def secret_scan(df: DataFrame, text: str, key: str, markers: Sequence[str]) -> DataFrame:
    """Rows whose text holds any of the marker patterns, with the patterns found."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(f"(?i){m}"), F.lit(m)) for m in markers]), lambda m: m.isNotNull())
    return df.select(key, hits.alias("markers")).where(F.size("markers") > 0)
