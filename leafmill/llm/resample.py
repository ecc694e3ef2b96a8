"""Importance resampling towards a target distribution over hashed n-grams.

Words are runs of bytes of letters, digits and non-ASCII characters (A-Z in lower case); features are all runs of one to three consecutive
words, joined by a space, hashed by CRC-32 into a fixed number of buckets. A bucket's gain is the scaled log ratio of
its smoothed shares in the target and in the corpus; a document's weight is the sum over its features, and
the documents with the highest weight plus Gumbel noise (fixed by the id) are drawn.

The kernel is a byte automaton over the Arrow buffer: a table classifies every byte, differences of the classes give
word boundaries, and table-driven CRCs advance from all word starts at once, a byte a step. A run of
two words goes on from the states of the runs of one, over the space and the next word.

Counts cover all rows; what goes to the driver has a number for each bucket. Ranks come from a sort by range.

Defined results: null or empty text, or one without words, has no features and weight 0; a null id is hashed as
the empty string and comes last among ties; rows that repeat an id are separate documents (equal rows that tie
are interchangeable); an empty corpus gives an empty result, an empty target gives only smoothed shares; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import ranks
from leafmill.llm import textkernel as K
from leafmill.llm.scratch import Scratch

BUCKETS = 10_000
GRAMS = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words longer than this go on in zlib, one by one.
STEPS = 256
_FULL = np.uint32(0xFFFFFFFF)
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _table()


def _advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after `lengths` more bytes from `starts`: longest words first, so those still running lead the arrays."""
    if not len(state):
        return state
    order = np.argsort(-lengths, kind="stable")
    s, at, n = state[order], starts[order], lengths[order]
    running = np.searchsorted(-n, -np.arange(min(int(n[0]), STEPS)), "left")
    for j, k in enumerate(running):
        s[:k] = _CRC[(s[:k] ^ raw[at[:k] + j]) & np.uint32(255)] ^ (s[:k] >> np.uint32(8))
    for i in range(int(np.searchsorted(-n, -STEPS, "left"))):
        s[i] = zlib.crc32(raw[at[i] + STEPS : at[i] + n[i]], int(s[i] ^ _FULL)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """n + 1 word offsets of n texts; then for 1, 2, 3 words the CRC-32 of the run from each word on, with 0 and a mask where none begins."""
    raw = K.LOWER[raw]
    word = _WORD[raw]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = off[(off > 0) & (off < len(word))]
    before[inner] = after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    at = np.searchsorted(starts, off)
    lengths = ends - starts
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        state = np.full(len(starts), _FULL)
        firsts = np.arange(len(starts))
        for k in range(GRAMS):
            if k:
                last = firsts + k
                going = last < len(starts)
                going[going] = owner[last[going]] == owner[firsts[going]]
                firsts, state = firsts[going], state[going]
                state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = _advance(state, raw, starts[firsts + k], lengths[firsts + k])
            yield firsts, state ^ _FULL

    return at, grams()


def _counted(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, off = K.texts(batch.column(0))
            for lo, hi in K.parts(raw, off):
                _, grams = features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for _, crc in grams:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of all texts fall into each bucket that has any."""
    return texts.select(F.col(text_col).alias("text")).mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket, from two tables of `bucket_counts`."""
    rows = spark.range(buckets).withColumnRenamed("id", "bucket")
    rows = rows.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    totals = rows.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    at_target = (F.col("t") + 1).cast("double") * F.lit(float(totals["S"] + buckets))
    at_corpus = (F.col("s") + 1).cast("double") * F.lit(float(totals["T"] + buckets))
    return rows.select("bucket", F.floor(1000 * F.ln(at_target / at_corpus)).alias("gain"))


def _weighed(gain: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.texts(batch.column(1))
            for lo, hi in K.parts(raw, off):
                at, grams = features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                upto = np.zeros(int(at[-1]) + 1, np.int64)
                for firsts, crc in grams:
                    upto[firsts + 1] += gain[crc % np.uint32(len(gain))]
                np.cumsum(upto, out=upto)
                n = np.diff(at)
                found = sum(np.maximum(0, n - k) for k in range(GRAMS))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(found), pa.array(upto[at[1:]] - upto[at[:-1]])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_weighed(np.array(gain, np.int64)), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, fixed by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for what is not drawn."""
    scratch = Scratch(spark, "resample")
    table = gains(spark, scratch.put(bucket_counts(docs, buckets=buckets), "corpus"), scratch.put(bucket_counts(target, buckets=buckets), "target"), buckets)
    gain = [r.gain for r in table.orderBy("bucket").collect()]  # a number for each bucket
    rows = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = scratch.put(rows, "scores")
    able = F.col("n_words") >= least_words
    draw = percent * rows.where(able).count() // 100
    order = ranks.placed(rows.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], scratch, "order")
    order = ranks.ranked(order).withColumn("rank", F.when(F.col("rank") < draw, F.col("rank") + 1))
    out = order.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT printf('%02X', byte) AS hex, byte::UBIGINT AS byte, c FROM bits WHERE k = 8),
words AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT side, d, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
own AS MATERIALIZED (SELECT side, d, f, count(*) AS n FROM runs GROUP BY ALL),
step AS (SELECT f, hex(encode(f)) AS h, 0 AS j, 4294967295::UBIGINT AS c FROM (SELECT DISTINCT f FROM own)
  UNION ALL SELECT f, h, j + 1, xor(step.c >> 8, t.c) FROM step JOIN crc b ON b.hex = substr(h, 2 * j + 1, 2) JOIN crc t ON t.byte = xor(step.c & 255, b.byte) WHERE 2 * j < length(h)),
hashed AS MATERIALIZED (SELECT f, xor(c, 4294967295::UBIGINT) % 10000 AS bucket FROM step WHERE 2 * j = length(h)),
tally AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM own JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM tally),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(tally.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(tally.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM tally, total),
weighed AS (SELECT d, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS weight FROM own JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY d),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weighed USING (d) WHERE side = 0),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM drawn
"""
