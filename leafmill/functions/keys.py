"""Content identity: stable hashes of rows and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text; null stays null."""
    return F.sha2(c.cast("binary"), 256)


def unit_hash(unit_id: Column, source: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.coalesce(unit_id, F.lit("")).alias("id"), F.coalesce(source, F.lit("")).alias("source"))), 256)


def row_key(*parts: Column) -> Column:
    """A cache key: any change of a part, null included, changes it."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def ordered_hash(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """SHA-256 over a group's values in order: plan and layout hashes. Groups are bounded by one document's records."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("_v"))))
    joined = F.array_join(F.transform(items, lambda x: x["_v"]), "\x1f")
    return df.groupBy(*by).agg(F.sha2(joined, 256).alias("hash"))


def is_fresh(*pairs: tuple[Column, Column]) -> Column:
    """All recorded values still equal the current ones, null-safely."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
