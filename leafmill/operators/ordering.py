"""Ordered operators: windows, islands, greedy grouping, ranking with a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.operators import boxes
from leafmill.session import cut


def layout_order(blocks: DataFrame, by: list[str], wide: Column, side: Column) -> DataFrame:
    """Reading order: zones between wide blocks; in a zone left, right, then ambiguous, by (y, x); a wide block closes its zone."""
    mid = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    w = Window.partitionBy(*by).orderBy(mid, "bbox.x0", "ord")
    zone = F.coalesce(F.sum(F.when(wide, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy(*by).orderBy("zone", F.when(wide, 3).otherwise(side), "bbox.y0", "bbox.x0", "ord")
    return blocks.withColumn("zone", zone).withColumn("position", F.row_number().over(order))


def count_inversions(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each group (numbered from 0, together and ascending) the pairs whose earlier value is greater.

    Bit by bit from the highest, within runs that agree on all bits above: n log n whatever the groups; only the order of values counts.
    """
    n = len(values)
    total = np.zeros(int(group[-1]) + 1 if n else 0, np.int64)
    _, v = np.unique(values, return_inverse=True)
    order, run_of = np.arange(n), group  # a stable sort by group and the bits seen so far
    for bit in range(int(v.max()).bit_length() - 1 if n else -1, -1, -1):
        one = (v[order] >> bit) & 1
        ones = np.cumsum(one)
        first = np.flatnonzero(np.concatenate(([True], run_of[1:] != run_of[:-1])))
        ahead = ones - np.repeat(ones[first] - one[first], np.diff(np.append(first, n)))  # ones so far in the run
        total += np.bincount(group[order], weights=np.where(one == 0, ahead, 0), minlength=len(total)).astype(np.int64)
        sort = np.lexsort((one, run_of))
        order, run_of = order[sort], (2 * run_of + one)[sort]
        run_of = np.cumsum(np.concatenate(([0], run_of[1:] != run_of[:-1])))
    return total


def _pairs(groups: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    def ties(*keys: np.ndarray) -> np.ndarray:
        """Pairs of each group that are equal in all keys."""
        at = np.lexsort((*keys, group))
        new = np.concatenate(([True], np.any([k[at][1:] != k[at][:-1] for k in (*keys, group)], axis=0)))
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        return np.bincount(group[at][new], weights=size * (size - 1) // 2, minlength=batch.num_rows).astype(np.int64)

    for batch in groups:
        x, y = (np.unique(batch.column(c).flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1] for c in ("_first", "_second"))
        n = batch.column("_first").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.repeat(np.arange(len(n)), n)
        comparable = n * (n - 1) // 2 - ties(x) - ties(y) + ties(x, y)
        discordant = count_inversions(y[np.lexsort((y, x, group))], group)  # equal firsts by second: they make no inversion
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(comparable), pa.array(discordant)], [*by, "comparable", "discordant"]).filter(pa.array(comparable > 0))


def inversions(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Comparable and discordant pairs of two orders within a group; ties in either are not comparable, null values neither; groups without a comparable pair have no row.

    Counted in n log n within a group, of which a task holds two numbers a row. Groups are documents or orders, never the table.
    """
    r = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, F.col(first).alias("_first"), F.col(second).alias("_second"))
    groups = r.groupBy(*by).agg(F.collect_list("_first").alias("_first"), F.collect_list("_second").alias("_second"))
    types = dict(groups.dtypes)
    return groups.mapInArrow(lambda batches: _pairs(batches, by), ", ".join(f"`{c}` {types[c]}" for c in by) + ", comparable long, discordant long")


def islands(rows: DataFrame, by: list[str], order: list, start: Column, end: Column, gap) -> DataFrame:
    """Adds `island`: a new one where a row starts more than `gap` after the end of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(end).over(w).isNull() | (start - F.lag(end).over(w) > gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union_length(rows: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Length of the union of intervals: a new island where a row starts after all earlier ends."""
    r = rows.select(*by, start.alias("s"), end.alias("e")).where("e >= s")
    w = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = r.groupBy(*by, "_island").agg((F.max("e") - F.min("s")).alias("length"))
    return one.groupBy(*by).agg(F.sum("length").alias("length"), F.count("*").alias("n_islands"))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _values(a: pa.Array) -> list:
    """Of a box its four sides."""
    return list(zip(*(a.field(c).to_pylist() for c in boxes.SIDES), strict=True)) if pa.types.is_struct(a.type) else a.to_pylist()


def _grouped(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"))


def _groups(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The rows of all groups of a batch, and the place of each one's group."""
    column = batch.column("_rows")
    return column.flatten(), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _each(rows: DataFrame, by: list[str], columns: list[str], order: str, step, added: str) -> DataFrame:
    """by, order and the columns of `added`: a Python step over each group's rows (tuples, in order; boxes as x0, y0, x1, y1), which returns a tuple for each row.

    Many groups share an Arrow batch, so small groups cost little; a group (a document or a page) is one step.
    """
    types = dict(rows.dtypes)
    names = [order, *(c for c in columns if c != order)]
    new = [x.split() for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, group = _groups(batch)
            every = list(zip(*(_values(flat.field(c)) for c in names), strict=True))
            ends = np.cumsum(np.bincount(group, minlength=batch.num_rows)).tolist()
            out = [r for lo, hi in zip([0, *ends], ends, strict=False) for r in step(every[lo:hi])]
            made = [pa.array([r[k] for r in out], _ARROW[kind]) for k, (_, kind) in enumerate(new)]
            keys = [batch.column(c).take(pa.array(group)) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, flat.field(order), *made], [*by, order, *(name for name, _ in new)])

    return _grouped(rows, by, names).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in [*by, order]) + ", " + added)


def cluster_boxes(drawings: DataFrame, grow: float = 14.0) -> DataFrame:
    """Adds `cluster`: connected boxes of a page, the least drawing number of each. drawings: doc_id, page, drawing_no, bbox.

    Clusters never cross a page, so they are found for each page, for all pages of a batch at once; a sweep by x keeps that from comparing all pairs.
    """
    by, types = ["doc_id", "page"], dict(drawings.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, group = _groups(batch)
            number = flat.field("drawing_no")
            first = boxes.connected(group, boxes.sides(flat.field("bbox")), grow)
            keys = [batch.column(c).take(pa.array(group)) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, number, number.take(pa.array(first)).cast(pa.int64())], [*by, "drawing_no", "cluster"])

    return _grouped(drawings, by, ["drawing_no", "bbox"]).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in (*by, "drawing_no")) + ", cluster long")


def rule_groups(rules: DataFrame, x_slack: float = 6.0, most_gap: float = 260.0) -> DataFrame:
    """First-fit: a rule joins the first group whose first rule has its x range (within slack) and whose last is near; groups of two or more stay."""

    def page(rows: list[tuple]) -> list[tuple]:
        own, groups = [b for _, b in rows], []
        for i in sorted(range(len(own)), key=lambda i: (own[i][1], own[i][0], i)):
            b = own[i]
            for g in groups:
                head, last = own[g[0]], own[g[-1]]
                if abs(head[0] - b[0]) <= x_slack and abs(head[2] - b[2]) <= x_slack and b[1] - last[3] <= most_gap:
                    g.append(i)
                    break
            else:
                groups.append([i])
        found = {i: n for n, g in enumerate(x for x in groups if len(x) >= 2) for i in g}
        return [(found.get(i, -1),) for i in range(len(rows))]

    return _each(rules.where("bbox is not null"), ["doc_id", "page"], ["bbox"], "drawing_no", page, "rule_group long").where("rule_group >= 0")


def pack(items: DataFrame, by: str, most_items: int = 20, most_chars: int = 12_000, soft_items: int = 8, soft_chars: int = 10_000) -> DataFrame:
    """Adds `batch`: consecutive items packed greedily. items: by, ord, chars, may_break, is_heading.

    A batch closes at a legal break when the next item would pass a limit, or at a heading once it is large enough. One
    fold over each document's ordered items.
    """
    row = F.struct("ord", F.col("chars").cast("long").alias("chars"), "may_break", "is_heading")
    doc = items.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<ord:bigint,batch:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] >= most_items) | (acc["c"] + x["chars"] > most_chars)
        ripe = x["is_heading"] & (acc["n"] >= soft_items) & (acc["c"] >= soft_chars)
        new = (acc["n"] > 0) & x["may_break"] & (full | ripe)
        batch = acc["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(
            batch.alias("batch"),
            (F.when(new, 0).otherwise(acc["n"]) + 1).alias("n"),
            (F.when(new, F.lit(0).cast("long")).otherwise(acc["c"]) + x["chars"]).alias("c"),
            F.concat(acc["out"], F.array(F.struct(x["ord"].cast("long").alias("ord"), batch.alias("batch")))).alias("out"),
        )

    return doc.select(by, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("r")).select(by, "r.ord", "r.batch")


def assign(rows: DataFrame, by: list[str], order: list, workers: int = 5) -> DataFrame:
    """Contiguous shares for at most `workers`; the first ones get one more."""
    return rows.withColumn("worker", F.ntile(workers).over(Window.partitionBy(*by).orderBy(*order)))


def paginate(blocks: DataFrame, height: float) -> DataFrame:
    """doc_id, ord, out_page, area, problem: blocks in order on pages of `height`.

    A group stands where its first block does and stays together; it moves to a new page if it fits one, as does a block that is higher than
    what is left. A footnote goes to the foot of the current page and takes nothing from the text's height, also within a group. What is higher
    than a page stays where it is, as a problem, unless it is a block that can be split. A document is one task, since each place depends on all before.
    blocks: doc_id, ord, group_id (nullable), height, splittable, footnote.
    """

    def doc(rows: list[tuple]) -> list[tuple]:
        members: dict = {}
        for i, (_, group, _, _, foot) in enumerate(rows):
            if group is not None and not foot:
                members.setdefault(group, []).append(i)
        page, free, at, problem = 1, height, [0] * len(rows), [None] * len(rows)
        for i, (_, group, _, splits, foot) in enumerate(rows):
            if foot:
                at[i] = page
                continue
            if at[i]:
                continue
            together = members.get(group, [i])
            need = sum(rows[r][2] or 0.0 for r in together)
            if need > height and (group is not None or not splits):
                for r in together:
                    problem[r] = "BLOCK_HIGHER_THAN_PAGE" if group is None else "GROUP_HIGHER_THAN_PAGE"
            elif need > free:
                page, free = page + 1, height
            for r in together:
                at[r] = page
            free -= need
        return [(at[i], "footer" if row[4] else "body", problem[i]) for i, row in enumerate(rows)]

    return _each(blocks, ["doc_id"], ["group_id", "height", "splittable", "footnote"], "ord", doc, "out_page int, area string, problem string")


def split_groups(pages: DataFrame) -> DataFrame:
    """Groups that ended up on several pages."""
    return pages.where("group_id is not null").groupBy("doc_id", "group_id").agg(F.count_distinct("out_page").alias("n_pages")).where("n_pages > 1")


def placement(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", "element_id").agg(F.array_sort(F.collect_set("out_page")).alias("pages"))


def rank_with_budget(rows: DataFrame, by: list[str], order: list, budget: int) -> DataFrame:
    """Adds `rank` and `selected`; what is beyond the budget stays in the result as not selected.

    Without groups, rows are sorted by range and numbered within each range, which the counts of the ranges before it complete: no task sees the
    whole table. The driver holds one count for each partition. `order` must be total, or ties may be numbered either way.
    """
    if by:
        out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))  # ranges are sampled: they must be drawn once
        counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
        before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_before")
        within = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
        out = within.join(F.broadcast(before), "_range").withColumn("rank", (F.col("rank") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_before")
    return out.withColumn("selected", F.col("rank") <= budget)


def newest(rows: DataFrame, by: str, order: list, keep: int, protected: Column) -> DataFrame:
    """Adds `prune`: all but the newest of each kind, protected ones never and not counted."""
    w = Window.partitionBy(by, protected).orderBy(*order)
    return rows.withColumn("prune", ~protected & (F.row_number().over(w) > keep))


def adjacent_overlaps(rows: DataFrame, by: list[str], order: list, target: str, source: str, page: str, kind: str) -> DataFrame:
    """Rows with `overlap`: letters their target repeats from the end of the row before, on the same or the next page, while the sources don't; references never count."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = {f"_{c}": F.lag(c).over(w) for c in dict.fromkeys((target, source, page, kind))}
    out = rows.withColumns(last).where((F.col(page) - F.col(f"_{page}")).between(0, 1))
    entry = lambda c: F.coalesce(F.lower(c).isin("reference", "references", "bibliography"), F.lit(False))
    out = out.where(~entry(kind) & ~entry(f"_{kind}")).withColumn("overlap", A.repeated_seam(f"_{target}", target, f"_{source}", source))
    return out.where("overlap > 0").drop(*last)


def column_clusters(rows: DataFrame, share: float = 0.11) -> DataFrame:
    """Adds `column_no`: left edges joined to the running mean of a cluster within the share of the page's width, in order of x."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        x = [b["x0"] for b in pdf["bbox"]]
        no = [0] * len(x)
        mean, n, k = 0.0, 0, -1
        for i in sorted(range(len(x)), key=lambda i: x[i]):
            if n == 0 or abs(x[i] - mean) > share * pdf["width"][i]:
                k, mean, n = k + 1, x[i], 1
            else:
                mean, n = (mean * n + x[i]) / (n + 1), n + 1
            no[i] = k
        pdf["column_no"] = no
        return pdf[["doc_id", "page", "ord", "column_no"]]

    schema = ", ".join(f"{c} {t}" for c, t in rows.select("doc_id", "page", "ord").dtypes) + ", column_no int"
    return rows.groupBy("doc_id", "page").applyInPandas(page, schema)


def first_that_fits(grid: list, fits) -> int | None:
    """Index of the first acceptable entry of an ordered grid: bisection if acceptance is monotone on the probes, else one by one."""
    if not grid:
        return None
    known: dict[int, bool] = {}

    def ok(i: int) -> bool:
        if i not in known:
            known[i] = bool(fits(grid[i]))
        return known[i]

    if ok(len(grid) - 1):
        lo, hi = 0, len(grid) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        seen = sorted(known)
        if all(known[a] <= known[b] for a, b in zip(seen, seen[1:])) and (lo == 0 or not ok(lo - 1)):
            return lo
    return next((i for i in range(len(grid)) if ok(i)), None)


def candidate_grid(sizes: list[float], leadings: list[float]) -> Iterator[tuple[float, float]]:
    return ((s, v) for s in sorted(sizes, reverse=True) for v in leadings)


def interline_gaps(lines: DataFrame, by: list[str], least: float = 4.0) -> DataFrame:
    """Line gaps of `least` font sizes or more between consecutive lines."""
    w = Window.partitionBy(*by).orderBy("bbox.y0", "bbox.x0")
    gap = (F.col("bbox.y0") - F.lag("bbox.y1").over(w)) / F.col("size")
    return lines.withColumn("gap", gap).where(F.col("gap") >= least)


def leading_ratio(lines: DataFrame, by: list[str]) -> DataFrame:
    """Exact median of baseline gap over size, within 0.8 to 3.0."""
    w = Window.partitionBy(*by).orderBy("bbox.y1", "bbox.x0")
    ratio = (F.col("bbox.y1") - F.lag("bbox.y1").over(w)) / F.col("size")
    return lines.select(*by, ratio.alias("r")).where("r between 0.8 and 3.0").groupBy(*by).agg(F.median("r").alias("leading"), F.count("*").alias("samples"))


def pair_overlaps(blocks: DataFrame, by: list[str], least: float = 0.35) -> DataFrame:
    """Pairs of boxes on a page that share `least` of the smaller one."""
    from leafmill.functions import geom as G

    on = F.col("a.ord") < F.col("b.ord")
    for k in by:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    smaller = F.least(G.area(F.col("a.bbox")), G.area(F.col("b.bbox")))
    share = F.when(smaller > 0, G.overlap(F.col("a.bbox"), F.col("b.bbox")) / smaller).otherwise(0.0)
    pairs = blocks.alias("a").join(blocks.alias("b"), on & (share >= least))
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.ord").alias("first"), F.col("b.ord").alias("second"), share.alias("share"))
