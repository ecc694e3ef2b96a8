"""Identities by content: Merkle digests over canonical nested values, kept from round to round.

A nested value is a table of leaves (key, path, leaf), a leaf being a typed canonical text. A node's digest is that of its children, sorted by name; children are
first digested in 4,096 buckets by name, so a node of any width is no single group. After a change only the nodes above
changed leaves are made again, from the stored digests of what else they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import cut

# Fields that no identity depends on, digits that coordinates are compared by.
IGNORED, DIGITS = ("xref", "number"), 3


def cache_key(source_sha256: Column, detector: Column, library: Column, analyzer: str = "source-structure-v1") -> Column:
    """Identity of an element inventory: source bytes, versions of detector and analyzer, major version of the reading library; any change invalidates."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    text = lambda c: F.regexp_extract(quoted(c), r'^\{"v":(.*)\}$', 1)
    parts = [("analyzer_version", F.lit(analyzer)), ("detector_version", detector), ("pymupdf_major", F.split(library, r"\.")[0]), ("source_sha256", source_sha256)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), text(F.coalesce(c, F.lit("")))) for name, c in parts]), F.lit("}")), 256)


def leaves(rows: DataFrame, key: str, value: str, ignored: tuple[str, ...] = IGNORED, digits: int = DIGITS) -> DataFrame:
    """key, path, leaf of a variant column: objects by field, arrays by place, numbers rounded, ignored fields left out. Empty containers and nulls are leaves.

    One round for each level of nesting; a table of empty or null values gives none.
    """
    cur, out = rows.where(F.col(value).isNotNull()).select(key, F.array().cast("array<string>").alias("path"), F.col(value).alias("v")), None
    while True:
        cur = cut(cur.withColumn("kind", F.schema_of_variant("v")))
        inner = F.col("kind").rlike("^(OBJECT|ARRAY)<.+>$") & ~F.col("kind").isin("OBJECT<>", "ARRAY<>") & (F.to_json("v") != "[]") & (F.to_json("v") != "{}")
        number = F.round(F.expr("try_variant_get(v, '$', 'double')"), digits)
        text = F.when(F.col("kind").rlike("^(DOUBLE|FLOAT|DECIMAL|BIGINT|INT)"), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(F.lower(F.substring("kind", 1, 1)), F.lit(":"), F.to_json("v")))
        flat = cur.where(~inner).select(key, "path", text.alias("leaf"))
        out = flat if out is None else out.unionByName(flat)
        deep = cur.where(inner)
        if deep.isEmpty():
            return out
        parts = deep.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner")
        each = deep.select(key, "path", "v").lateralJoin(parts).select(key, "path", "pos", "name", F.col("inner").alias("v"))
        each = each.where(F.col("name").isNull() | ~F.col("name").isin(*ignored))
        cur = each.select(key, F.array_append("path", F.coalesce("name", F.lpad(F.col("pos").cast("string"), 9, "0"))).alias("path"), "v")


def _combined(children: DataFrame, key: str) -> DataFrame:
    """key, path, digest of nodes from (key, path of the node, name, digest) of all their children."""
    bucket = F.substring(F.sha2("name", 256), 1, 3)
    line = F.concat_ws("=", F.sha2("name", 256), "digest")
    sorted_ = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ";"), 256)
    part = children.groupBy(key, "path", bucket.alias("b")).agg(sorted_(line).alias("d"))
    return part.groupBy(key, "path").agg(sorted_(F.concat_ws("=", "b", "d")).alias("digest"))


def _up(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes as children of the node above."""
    n = F.size("path")
    return nodes.where(n > 0).select(key, F.slice("path", 1, n - 1).alias("path"), F.element_at("path", -1).alias("name"), "digest")


def digests(leaf_rows: DataFrame, key: str) -> DataFrame:
    """key, path, digest of every leaf and node; the empty path is the whole value. A level at a time from the deepest: two grouped digests each.

    Equal rows of a path count once; a path is a leaf or a node, as in any nested value, not both.
    """
    base = cut(leaf_rows.select(key, "path", F.sha2(F.concat(F.lit("leaf:"), "leaf"), 256).alias("digest")).distinct())
    depth = base.agg(F.max(F.size("path"))).first()[0]
    done, level = base, None
    for d in range(depth if depth is not None else 0, 0, -1):
        here = base.where(F.size("path") == d)
        level = cut(_combined(_up(here if level is None else here.unionByName(level), key), key))
        done = done.unionByName(level)
    return done


def refresh(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The digests after a round: (`stored` of the round before) with `changed` leaves (key, path, leaf; a null leaf is a removal) and only what lies above them made again.

    What is read of the rest is the stored children of nodes that changed. Nodes whose last child goes are removed, too.
    """
    new = changed.select(key, "path", F.when(F.col("leaf").isNotNull(), F.sha2(F.concat(F.lit("leaf:"), "leaf"), 256)).alias("digest")).distinct()
    touched = cut(new)
    depth = touched.agg(F.max(F.size("path"))).first()[0]
    made = touched
    for d in range(depth if depth is not None else 0, 0, -1):
        here = made.where(F.size("path") == d)
        above = here.select(key, F.slice("path", 1, d - 1).alias("path")).distinct()
        kept = stored.where(F.size("path") == d).withColumn("_p", F.slice("path", 1, d - 1))
        kept = kept.join(above.withColumnRenamed("path", "_p"), [key, "_p"], "left_semi").select(key, "path", "digest")
        kept = kept.join(here.select(key, "path"), [key, "path"], "left_anti")
        combined = _combined(_up(kept.unionByName(here.where("digest is not null")), key), key)
        parents = above.join(combined, [key, "path"], "left").select(key, "path", "digest")
        made = cut(made.unionByName(parents))
    return stored.join(made.select(key, "path"), [key, "path"], "left_anti").unionByName(made.where("digest is not null"))


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, path, change (`added`, `removed`, `changed`) of all paths whose digests differ."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.path") == F.col("b.path")), "full")
    change = F.when(F.col("a.digest").isNull(), "added").when(F.col("b.digest").isNull(), "removed").when(F.col("a.digest") != F.col("b.digest"), "changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).where("change is not null")


def build_identity(files: DataFrame, by: list[str]) -> DataFrame:
    """by, build_id: identity of a set of files (path, sha256), whatever their order."""
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\t", "path", "sha256"))), "\n"), 256).alias("build_id"))


def variants(spark: SparkSession, rows: DataFrame, key: str, json: str) -> DataFrame:
    """`key` and the value of a JSON column as `v`; what is no JSON is null."""
    return rows.select(key, F.try_parse_json(json).alias("v"))
