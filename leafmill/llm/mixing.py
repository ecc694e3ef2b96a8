"""Mixing sources to target weights by weighted fair queueing.

Sources, by code point with null last, weigh 3, 1, 2, repeating. Together they get 1.5 times all words; a
source's target stops at `cap` times its own size, and the excess is shared again by weight until none is above.
Each source queues its documents in a fixed shuffled order (MD5 of the id), `cap` rounds of them. A copy's
virtual finish time is the source's words so far over its target; copies are ordered by finish time
over all sources and cut where the total reaches the budget, so every source ends near its target.

Running sums are hierarchical: a source's order is cut into about sqrt(n) ranges of about sqrt(n)
documents, and so is the global order, so no task holds a source or the table.

Defined results: null text has size 0; a source without words has target 0 and nothing is taken; a null id
is shuffled as the empty string; rows that repeat an id are separate documents; ties follow (MD5, id, size), and rows
that tie in all of these are interchangeable; an empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
CAP = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, n_docs, source_size, target. sizes: (source, n_docs, source_size), a row for each source.

    A source is below its cap if the level left by all sources that fill up earlier (least cap per weight first)
    doesn't fill it: one ordered pass, in whole numbers up to the last division.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("twice", F.sum("source_size").over(all_rows) * 3)
    t = t.withColumn("below", (F.col("twice") - 2 * F.col("full")) * F.col("w") <= 2 * F.col("cap") * F.col("left_w"))
    first = F.min(F.when(F.col("below"), F.struct(F.col("left_w") * -1, (F.col("twice") - 2 * F.col("full")).alias("left")))).over(all_rows)
    t = t.withColumn("first", first)
    # min over -left_w picks the largest remaining weight: the first source that is below its cap
    share = (F.col("w") * F.col("first.left")).cast("double") / (2 * -F.col("first.col1")).cast("double")
    target = F.when(F.col("below"), share).otherwise(F.col("cap").cast("double"))
    return t.select("source", "n_docs", "source_size", target.alias("target"))


def plan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP) -> DataFrame:
    """doc_id, source, md5, size, source_size, target, copies and taken of every row."""
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = sized.withColumn("r", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized = scratch.put(sized, "sizes")

    sources = targets(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), cap=cap)
    sources = scratch.put(sources.withColumn("ranges", F.ceil(F.sqrt("n_docs")).cast("long")), "sources")
    totals = sources.agg(F.sum("n_docs").alias("n"), F.sum("source_size").alias("words")).first()
    n, words = totals["n"] or 0, totals["words"] or 0
    budget = 1.5 * words
    rows = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "ranges")
    slot = F.floor(F.conv(F.substring("r", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32))).cast("long")
    rows = rows.withColumn("slot", slot)
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "slot", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "slot").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("size").over(within)).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.slot") == F.col("o.slot"))
    rows = rows.join(sums.alias("o"), same).select("d.doc_id", "d.source", "d.size", "d.r", "d.source_size", "d.target", (F.col("cum") + F.col("ahead")).alias("cum"))
    rows = scratch.put(rows, "queue")

    # copies by finish time: ranges of the global order, then the one range in which the budget ends
    round_no = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    copies = rows.where("target > 0").select("r", "doc_id", "size", "target", "source_size", "cum", round_no.alias("round"))
    finish = (F.col("cum") + F.col("round") * F.col("source_size")).cast("double") / F.col("target")
    copies = copies.select("r", "doc_id", "size", finish.alias("finish"))
    slots = max(1, int((cap * n) ** 0.5))
    copies = copies.withColumn("slot", F.floor(F.col("finish") * slots).cast("long"))
    by_slot = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    running = by_slot.withColumn("upto", F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    edge = running.where(F.col("upto") > budget).orderBy("slot").select("slot", (F.col("upto") - F.col("slot_size")).alias("ahead")).head()
    if edge is None:
        taken_rounds = F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0))
    else:
        upto = F.lit(edge["ahead"]) + F.sum("size").over(Window.orderBy("finish", "r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
        last = copies.where(F.col("slot") == edge["slot"]).withColumn("upto", upto).where(F.col("upto") <= budget)
        last = last.orderBy(F.desc("finish"), F.desc("r"), F.desc("doc_id"), F.desc("size")).head()
        taken_rounds = F.lit(0)
        for k in range(cap):
            f = (F.col("cum") + k * F.col("source_size")).cast("double") / F.col("target")
            if last is None:
                ok = F.floor(f * slots) < edge["slot"]
            else:
                tie = F.struct(F.col("r"), F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("size"))
                cut = F.struct(F.lit(last["r"]), F.lit(-(1 << 63) if last["doc_id"] is None else last["doc_id"]).cast("long"), F.lit(last["size"]).cast("long"))
                ok = (f < F.lit(last["finish"])) | ((f == F.lit(last["finish"])) & (tie <= cut))
            taken_rounds = taken_rounds + F.when((F.col("target") > 0) & ok, 1).otherwise(0)
    rows = rows.withColumn("copies", taken_rounds.cast("int"))
    return rows.select("doc_id", "source", "r", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as the plan takes it, with its columns.

    A row's plan is found by (id, source, size). Rows that share all three are interchangeable: together they get as many
    copies as the plan gives them; if it does not give each the same, those first by a hash of their text get one more.
    """
    own = plan(spark, docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("all"), F.count("*").alias("n"))
    each = F.floor(F.col("all") / F.col("n")).cast("int")
    copies = own.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), each.alias("_copies"), (F.col("all") - each * F.col("n")).alias("_more"))
    copies = Scratch(spark, "mix").put(copies.where("_copies > 0 or _more > 0"), "copies")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    on = docs["doc_id"].eqNullSafe(F.col("_i")) & docs["source"].eqNullSafe(F.col("_s")) & (size == F.col("_z"))
    out = docs.join(copies, on)
    if not copies.where("_more > 0").isEmpty():  # at most a few runs of equal rows, at the end of the budget
        nth = F.row_number().over(Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64("text")))
        uneven = docs.join(copies.where("_more > 0"), on).withColumn("_copies", F.col("_copies") + (nth <= F.col("_more")).cast("int"))
        out = docs.join(copies.where("_more = 0"), on).unionByName(uneven)
    return out.where("_copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS r FROM documents),
s0 AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s0),
s2 AS (SELECT *, [3, 1, 2][((rk - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w, 3 * sum(source_size) OVER () AS twice
  FROM s2 WINDOW b AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (twice - 2 * full_) * w <= 2 * cap * left_w AS below FROM s3),
f AS (SELECT left_w AS fw, twice - 2 * full_ AS fl FROM s4 WHERE below ORDER BY left_w DESC LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN below THEN (w * fl)::DOUBLE / (2 * fw)::DOUBLE ELSE cap::DOUBLE END AS target FROM s4 LEFT JOIN f ON true),
q AS (SELECT d.doc_id, d.size, d.r, s.source_size, s.target,
  sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT q.*, (cum + k * source_size)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1]) AS k) WHERE target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, r, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
t AS (SELECT doc_id, sum(CASE WHEN upto <= 1.5 * (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken FROM g GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM q LEFT JOIN t ON q.doc_id = t.doc_id
"""
