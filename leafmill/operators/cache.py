"""Results of batches kept under a key of everything they depend on: any change makes another key, so nothing stale is ever found.

Keys are JVM-side digests; lookups, writes and removals are joins by key. A cache is a table: cache_key, results, written (an order of writes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Versions that are part of every key.
SCHEMA, PROMPT, STRATEGY = "1.0", "batch-prompt-v1", "batched-units-v1"


def _json(c: Column) -> Column:
    """A string as a JSON string; null as an empty one."""
    inner = F.to_json(F.array(F.coalesce(c.cast("string"), F.lit(""))))
    return F.substr(inner, F.lit(2), F.char_length(inner) - 2)


def unit_hash(unit_id: Column, source: Column) -> Column:
    """SHA-256 of a unit's id and source text."""
    return F.sha2(F.concat(F.lit('{"id": '), _json(unit_id), F.lit(', "source": '), _json(source), F.lit("}")), 256)


def batch_keys(units: DataFrame, by: list[str], order: list[str], unit_id: str, source: str, inputs: DataFrame) -> DataFrame:
    """by, cache_key, n_units: the digest of a batch's unit hashes in order with the languages, terms, versions and model it was made with.

    inputs: by, target_language, terminology_sha256 and, nullable, model, prompt_version, strategy_version. A batch without inputs has no key.
    """
    rows = units.select(*by, *order, unit_hash(F.col(unit_id), F.col(source)).alias("_h"))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "_h"))).alias("_rows"), F.count("*").alias("n_units"))
    hashes = F.concat(F.lit('["'), F.array_join(F.transform("_rows", lambda r: r["_h"]), '", "'), F.lit('"]'))
    parts = {
        "cache_schema_version": F.lit(SCHEMA),
        "model": F.col("model"),
        "prompt_version": F.coalesce("prompt_version", F.lit(PROMPT)),
        "strategy_version": F.coalesce("strategy_version", F.lit(STRATEGY)),
        "target_language": F.col("target_language"),
        "terminology_sha256": F.col("terminology_sha256"),
    }
    body = F.concat(F.lit("{"), *[F.concat(F.lit(f'"{k}": '), _json(v), F.lit(", ")) for k, v in parts.items()], F.lit('"unit_hashes": '), hashes, F.lit("}"))
    return g.join(inputs, by).select(*by, F.sha2(body, 256).alias("cache_key"), "n_units")


def lookup(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Every batch with its results and `hit`; a null entry is no hit."""
    c = cache.where("results is not null").select("cache_key", "results")
    return keys.join(c, "cache_key", "left").withColumn("hit", F.col("results").isNotNull())


def put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with what is fresh: of one key the last written stays."""
    both = cache.select("cache_key", "results", "written").unionByName(fresh.select("cache_key", "results", "written"))
    return both.groupBy("cache_key").agg(F.max_by(F.struct("results", "written"), "written").alias("e")).select("cache_key", "e.results", "e.written")


def drop(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without these keys; unknown ones are no error."""
    return cache.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")
