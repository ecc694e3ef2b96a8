"""Line dedup: levelled sorted runs of line hashes.

A log-structured index of lines: each batch of documents (batches follow the ids) reduces its lines to one row
per key, merge-anti-joins the runs already there, and adds what is new as a sorted run of level 0. When a
level holds `fanout` runs they are compacted into one run of the next level. A run's rows are
(h1, h2, owner): 128 bits of key hash and the smallest id that holds the line, since earlier batches have smaller ids.
A line is dropped where its key's owner has a smaller id.

Defined results: a null or empty text is one empty line; a row with null id neither owns nor loses lines;
rows that repeat an id count as one document; an empty table gives an empty result. Extra columns pass through
`dedup_lines` unchanged; a column named `n_lines` or `n_dropped` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_STRIP = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def _h1(key: Column) -> Column:
    return F.xxhash64(key)


class LineIndex:
    """The runs, by level. `add` takes one batch of (h1, h2, id) rows whose ids are above all earlier ones."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT) -> None:
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = rows.sortWithinPartitions("h1", "h2")
        self.levels[level].append(self.scratch.put(run, f"run-level{level}"))

    def add(self, batch: DataFrame) -> None:
        new = batch.groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(new, 0)
        self._compact(0)

    def _compact(self, level: int) -> None:
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, merged = self.levels[level], self.levels[level][0]
            for run in old[1:]:
                merged = merged.unionByName(run)
            self.levels[level] = []
            self._write(merged.repartition("h1", "h2"), level + 1)
            self.scratch.drop(*old)
            level += 1

    def owners(self) -> DataFrame | None:
        runs = self.runs()
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)  # a key is in one run only
        return out


def dropped_keys(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """id and the hashes of the keys whose lines it loses."""
    scratch = Scratch(spark, "linededup")
    ids = docs.where(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 10_000)).first()
    bounds = sorted(set(ids[0] or [])) if batches > 1 else []
    batch = F.lit(0)
    for k, bound in enumerate(bounds):
        batch = F.when(F.col("id") > F.lit(bound), k + 1).otherwise(batch)
    key = F.explode(F.filter(F.transform(lines_of(F.col(text_col)), key_of), lambda x: F.char_length(x) >= min_chars))
    keys = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"))
    keys = keys.select("id", _h1(F.col("key")).alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), batch.alias("batch"))
    keys = scratch.put(keys, "keys")
    index = LineIndex(scratch, fanout)
    for k in range(len(bounds) + 1):
        index.add(keys.where(F.col("batch") == k).select("h1", "h2", "id"))
    hit = keys.select("h1", "h2", "id").join(index.owners(), ["h1", "h2"]).where(F.col("id") > F.col("owner"))
    return hit.groupBy("id").agg(F.collect_set("h1").alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with the kept text in `text_col`, `n_lines` before dropping and `n_dropped`."""
    lost = dropped_keys(docs.sparkSession, docs, id_col, text_col, min_chars, batches, fanout)
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    lost = lost.select(F.col("id").alias("_lost_id"), F.col("lost").alias("_lost"))
    out = docs.join(lost, docs[id_col] == F.col("_lost_id"), "left")
    lines = lines_of(F.col(text_col))
    stays = lambda x: (F.char_length(key_of(x)) < min_chars) | ~F.array_contains(F.col("_lost"), _h1(key_of(x)))
    kept = F.when(F.col("_lost").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    n_kept = F.when(F.col("_lost").isNull(), F.size(lines)).otherwise(F.size(F.filter(lines, stays)))
    out = out.withColumn("_kept", kept).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", (F.size(lines) - n_kept).cast("long"))
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(c) for c in names], "n_lines", "n_dropped")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
