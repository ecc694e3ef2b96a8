"""SimHash fingerprints and search within a Hamming radius.

Each word (A-Z in lower case) votes for the bits of its 64-bit hash with a weight that grows with its
length, every occurrence anew. A bit of the fingerprint is set if the votes for it prevail. Votes are added in
four 16-bit lanes of a 64-bit integer, so a whole batch is a few vectorised sums.

Search: the 64 bits are cut into `radius + 2` blocks; two fingerprints within the radius agree on at least two
of them, so a table for each pair of blocks, keyed by these, finds all of them; candidates are then
checked by the exact distance.

Defined results: null or empty text, or one without words, has fingerprint 0; rows with null ids come last
in the order of neighbours; rows that repeat an id are ordered by text; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import textkernel as K
from leafmill.llm.scratch import Scratch

RADIUS = 3
_U = np.uint64
_RUN = 1000  # words in one lane sum: 1000 x 64 < 65536
_LANES = np.array([sum(((n >> j) & 1) << (16 * j) for j in range(4)) for n in range(16)], np.uint64)
_LAST = -(1 << 63)


def fingerprints(array: pa.Array) -> np.ndarray:
    """uint64 fingerprints of an Arrow string array."""
    raw, off = K.texts(array)
    out = np.zeros(len(array), np.uint64)
    for lo, hi in K.parts(raw, off):
        starts, ends, h, at = K.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
        if not len(h):
            continue
        weight = np.minimum(ends - starts, 8).astype(np.uint64) ** _U(2)
        n = np.diff(at)
        full = np.flatnonzero(n)
        runs = np.concatenate([np.arange(at[i], at[i + 1], _RUN) for i in full])
        owner = np.searchsorted(at[full], runs, "right") - 1
        first = np.searchsorted(owner, np.arange(len(full)))
        total = np.add.reduceat(np.add.reduceat(weight.astype(np.int64), runs), first)
        bits = np.zeros(len(full), np.uint64)
        for nibble in range(16):
            lanes = np.add.reduceat(_LANES[(h >> _U(4 * nibble)) & _U(15)] * weight, runs)
            for j in range(4):
                votes = np.add.reduceat(((lanes >> _U(16 * j)) & _U(0xFFFF)).astype(np.int64), first)
                bits |= (2 * votes > total).astype(np.uint64) << _U(4 * nibble + j)
        out[lo + full] = bits
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - distance / 64."""
    return 1 - np.bitwise_count(a ^ b) / 64


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_prints, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Bit masks of all pairs of `radius + 2` blocks."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp): all distinct fingerprints of `index` within the radius of each distinct one of `queries`."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        table = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)]))
        return df.select("fp").distinct().select(F.col("fp").alias(name), table.alias("k")).select(name, "k.t", "k.key")

    pairs = keyed(queries, "query").join(keyed(index, "fp"), ["t", "key"])
    return pairs.where(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius).select("query", "fp").distinct()


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in descending order, its halo last: each row meets the row after it."""
    import hashlib

    held = None  # (part, id, text, fingerprint)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            part, ids, halo, texts = (some.column(k).to_pylist() for k in range(4))
            texts = [x or "" for x in texts]
            fps = fingerprints(pa.array(texts, pa.string()))
            rows = []
            for row in zip(part, ids, halo, texts, fps, strict=True):
                if held and held[0] == row[0]:
                    n = len(held[2])
                    edited = held[2][: n - n // 2] + row[3][: n // 2]
                    rows.append((held[1], n, edited, held[3], row[4]))
                    held = None
                if not row[2]:
                    held = (row[0], row[1], row[3], row[4])
            if rows:
                ids, n, edited, own, after = zip(*rows, strict=True)
                own, after = np.array(own, np.uint64), np.array(after, np.uint64)
                changed = fingerprints(pa.array(edited, pa.string()))
                shown = lambda x: [f"{int(v):016x}" for v in x]
                sha = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited]
                columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), sha, shown(own), shown(changed), likeness(own, changed), likeness(own, after), own.view(np.int64)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "fp"])


def compare_edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document.

    The next document (descending id, after the last the first) is found without a global sort in one task: ids are cut into
    parts, and a part gets a copy of the row that follows its last one.
    """
    from pyspark.ml.feature import Bucketizer

    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LAST)).cast("double"))
    cuts = docs.agg(F.percentile_approx("key", [k / wanted for k in range(1, wanted)], 4 * wanted)).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="key", outputCol="part").transform(docs).withColumn("part", F.col("part").cast("int"))
    else:
        docs = docs.withColumn("part", F.lit(0))
    top = {r["part"]: r["top"] for r in docs.groupBy("part").agg(F.max(F.coalesce("doc_id", F.lit(_LAST))).alias("top")).collect()}  # a row for each part
    full = sorted(top)
    follows = [(top[full[k - 1]], part) for k, part in enumerate(full)]  # part 0 is followed by the first of all
    halo = spark.createDataFrame(follows, "top long, target int")
    own = docs.select("part", "doc_id", F.lit(False).alias("halo"), "text")
    extra = docs.join(F.broadcast(halo), F.coalesce("doc_id", F.lit(_LAST)) == F.col("top")).select(F.col("target").alias("part"), "doc_id", F.lit(True).alias("halo"), "text")
    rows = own.unionByName(extra).repartition(wanted // 4, "part").sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(
        _edited,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fp long",
    )


def report(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`compare_edited`, and for every document whose id is divisible by 100 how many others lie within the radius."""
    rows = Scratch(spark, "simhash").put(compare_edited(spark, docs), "prints")
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    found = near(rows.where("doc_id % 100 = 0"), counts, radius)
    totals = found.join(counts, "fp").groupBy("query").agg(F.sum("n").alias("n"))
    out = rows.alias("r").join(totals.alias("t"), (F.col("r.fp") == F.col("t.query")) & (F.col("r.doc_id") % 100 == 0), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", (F.col("t.n") - 1).alias("n_near"))
