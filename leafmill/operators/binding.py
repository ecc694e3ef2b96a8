"""Joins by key, position and content. Spatial joins are equi-joins on (document, page) with a predicate inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.functions import text as X
from leafmill.operators import needles as minimizers

KEYS = ("doc_id", "page")


def _on(a: str, b: str, keys=KEYS) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return on


def bind_by_block(units: DataFrame, elements: DataFrame) -> DataFrame:
    """unit_id, element_id through a shared block: the unit's first such block, then the first element."""
    u = units.select("doc_id", "page", "unit_id", F.posexplode("block_ids").alias("at", "block_id"))
    e = elements.select("doc_id", "page", "element_id", F.col("ord").alias("e_ord"), F.explode("block_ids").alias("block_id"))
    hits = u.join(e, ["doc_id", "page", "block_id"])
    return hits.groupBy("doc_id", "unit_id").agg(F.min_by("element_id", F.struct("at", "e_ord")).alias("element_id")).withColumn("match", F.lit("block"))


def bind_by_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = 0.55, last_wins: bool = True) -> DataFrame:
    """The right box that covers most of each left box, at least `least` of it; equal shares go to the last (or first) `ord`."""
    pairs = left.alias("a").join(right.alias("b"), _on("a", "b") & (G.overlap_share(F.col("a.bbox"), F.col("b.bbox")) >= least))
    order = F.col("b.ord") if last_wins else -F.col("b.ord")
    rank = F.struct(G.overlap_share(F.col("a.bbox"), F.col("b.bbox")).alias("share"), order.alias("o"))
    return pairs.groupBy(F.col("a.doc_id").alias("doc_id"), F.col(f"a.{left_id}").alias(left_id)).agg(F.max_by(F.col(f"b.{right_id}"), rank).alias(right_id)).withColumn("match", F.lit("overlap"))


def bind(units: DataFrame, elements: DataFrame) -> DataFrame:
    """Every unit once: by block, else by overlap, else an orphan with null element."""
    exact = bind_by_block(units, elements)
    rest = units.join(exact.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_anti")
    near = bind_by_overlap(rest, elements, "unit_id", "element_id")
    bound = exact.unionByName(near)
    orphans = units.select("doc_id", "unit_id").join(bound.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_anti")
    return bound.unionByName(orphans.withColumn("element_id", F.lit(None).cast("string")).withColumn("match", F.lit("orphan")))


def unbound_elements(elements: DataFrame, bindings: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    return elements.where(~F.col("type").isin(list(exempt))).join(bindings.where("element_id is not null").select("doc_id", "element_id"), ["doc_id", "element_id"], "left_anti")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, within: float | None = 90.0, keys=KEYS) -> DataFrame:
    """The nearest right box on the page, the first of equals; the limit is applied after the choice."""
    d = G.distance(F.col("a.bbox"), F.col("b.bbox"))
    pairs = left.alias("a").join(right.alias("b"), _on("a", "b", keys))
    out = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{left_id}").alias(left_id)).agg(
        F.min_by(F.struct(F.col(f"b.{right_id}").alias("id"), d.alias("distance")), F.struct(d.alias("d"), F.col("b.ord"))).alias("best")
    )
    out = out.select(*keys, left_id, F.col("best.id").alias(right_id), F.col("best.distance").alias("distance"))
    return out if within is None else out.where(F.col("distance") <= within)


def caption_above(regions: DataFrame, captions: DataFrame, region_id: str, caption_id: str, within: float = 60.0) -> DataFrame:
    """The caption that ends 0 to 60 above a region; of equals the last."""
    gap = F.col("a.bbox.y0") - F.col("b.bbox.y1")
    pairs = regions.alias("a").join(captions.alias("b"), _on("a", "b") & gap.between(0, within))
    return pairs.groupBy(F.col("a.doc_id").alias("doc_id"), F.col(f"a.{region_id}").alias(region_id)).agg(F.min_by(F.col(f"b.{caption_id}"), F.struct(gap.alias("g"), (-F.col("b.ord")).alias("o"))).alias(caption_id))


def inside(left: DataFrame, right: DataFrame, slack: float = 0.0) -> DataFrame:
    """Left rows whose centre lies in some right box of the page."""
    return left.alias("a").join(right.alias("b"), _on("a", "b") & G.centre_in(F.col("a.bbox"), F.col("b.bbox"), slack), "left_semi")


def covered(left: DataFrame, right: DataFrame, least: float = 0.60) -> DataFrame:
    """Left rows of which some right box covers the share."""
    return left.alias("a").join(right.alias("b"), _on("a", "b") & (G.overlap_share(F.col("a.bbox"), F.col("b.bbox")) >= least), "left_semi")


def outside(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Left rows that no right box holds: neither their centre nor half of their area."""
    hit = G.centre_in(F.col("a.bbox"), F.col("b.bbox")) | (G.overlap_share(F.col("a.bbox"), F.col("b.bbox")) >= least)
    return left.alias("a").join(right.alias("b"), _on("a", "b") & hit, "left_anti")


def not_ready(new: DataFrame, ready: DataFrame, least: float = 0.5) -> DataFrame:
    """New regions that repeat no ready one: another source id, and less than half of the smaller area in common."""
    smaller = F.least(G.area(F.col("a.bbox")), G.area(F.col("b.bbox")))
    same = (F.col("a.xref") == F.col("b.xref")) | ((smaller > 0) & (G.overlap(F.col("a.bbox"), F.col("b.bbox")) >= least * smaller))
    return new.alias("a").join(ready.alias("b"), _on("a", "b") & same, "left_anti")


def bind_scored(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units to source blocks by 2 x overlap + 1 for equal text; either an overlap of 0.55 or equal text; of equals the first."""
    same = X.clean(F.col("a.text")) == X.clean(F.col("b.text"))
    share = G.overlap_share(F.col("a.bbox"), F.col("b.bbox"))
    score = 2 * share + F.when(same, 1.0).otherwise(0.0)
    pairs = units.alias("a").join(blocks.alias("b"), _on("a", "b") & ((share >= 0.55) | same))
    return pairs.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.unit_id").alias("unit_id")).agg(F.max_by(F.col("b.block_id"), F.struct(score.alias("s"), (-F.col("b.ord")).alias("o"))).alias("block_id"))


SMALL = 200_000  # needles, of `SMALL_CHARS` characters in all, that are sent to every executor
SMALL_CHARS = 20_000_000


def find_needles(texts: DataFrame, key: str, text: Column, needles: DataFrame) -> DataFrame:
    """key, needle: the distinct needles that stand somewhere in each text. needles: one column `needle`; empty ones are left out.

    Up to `SMALL` needles go to every executor as one automaton, which reads each text once and needs no shuffle. More are met by equality of
    minimizers (`needles.find`), whatever their number and lengths.
    """
    wanted = needles.select("needle").where("needle <> ''").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("needle")), F.lit(0)).alias("chars")).first()
    v = texts.select(key, X.text(text).alias("v"))
    if size.n <= SMALL and size.chars <= SMALL_CHARS:
        shared = texts.sparkSession.sparkContext.broadcast([r.needle for r in wanted.collect()])

        def scan(batches):
            import ahocorasick
            import pandas as pd

            machine = ahocorasick.Automaton()
            for needle in shared.value:
                machine.add_word(needle, needle)
            machine.make_automaton()
            for pdf in batches:
                ids, found = [], []
                for id_, value in zip(pdf[key], pdf["v"], strict=True):
                    hits = {needle for _, needle in machine.iter(value)} if len(machine) else ()
                    ids += [id_] * len(hits)
                    found += sorted(hits)
                yield pd.DataFrame({key: pd.Series(ids, dtype=pdf[key].dtype), "needle": pd.Series(found, dtype="object")})

        return v.mapInPandas(scan, f"`{key}` {dict(v.dtypes)[key]}, needle string")
    return minimizers.find(v, [key], F.col("v"), wanted)


def contains_probes(items: DataFrame, pages: DataFrame, item_id: str, page_id: str, size: int = 24, most: int = 6) -> DataFrame:
    """Pages that contain a probe of an item: n_probes hit by (item, page). items and pages: id and `text`, compared without white space."""
    probe = items.select(item_id, F.explode(F.array_distinct(X.probes(F.col("text"), size, most))).alias("needle"))
    hits = find_needles(pages, page_id, X.probe_text(F.col("text")), probe)
    return hits.join(probe, "needle").groupBy(item_id, page_id).agg(F.count("*").alias("n_probes"))


def anchor_pages(items: DataFrame, pages: DataFrame, item_id: str, page_id: str, least: int = 2) -> DataFrame:
    """Pages whose text holds most of an item's anchors, all of equals, from two on. items: id and `anchor`; pages: id and `text`, without white space."""
    anchors = items.select(item_id, F.col("anchor").alias("needle")).distinct()
    hits = find_needles(pages, page_id, X.probe_text(F.col("text")), anchors).join(anchors, "needle").groupBy(item_id, page_id).agg(F.count("*").alias("n_hits"))
    hits = hits.where(F.col("n_hits") >= least)
    best = hits.groupBy(item_id).agg(F.max("n_hits").alias("best"))
    return hits.join(best, item_id).where(F.col("n_hits") == F.col("best")).select(item_id, page_id, "n_hits")


def fingerprint_nearest(queries: DataFrame, index: DataFrame, block: str, limit: float, contrast: float, rows: int = 32768) -> DataFrame:
    """Nearest of each query by mean absolute difference, within a block key, limit and contrast floor. Columns: id, v, and the block.

    All queries of a block meet all of its rows. A block of more than about `rows` queries or rows is dealt into parts, and each pair of parts meets in
    one step, which holds both as arrays: no pair of rows is ever a row. Vectors are sent as given, once for each part of the other side, and compared as doubles.
    """
    from leafmill.operators import closest

    wide = F.transform("v", lambda x: x.cast("double"))
    n_parts = lambda df, name: df.groupBy(block).agg(F.ceil(F.count("*") / rows).alias(name))
    large = n_parts(queries, "_nq").join(n_parts(index, "_nx"), block).where("_nq > 1 or _nx > 1")  # at most a row for each `rows` rows
    q_id, x_id = queries.schema["id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        kept = df.select(*[F.col(c).alias(c) for c in ("id", "v", block)]).where(F.col("id").isNotNull() & F.col(block).isNotNull() & (G.contrast(wide) >= contrast))
        kept = kept.join(F.broadcast(large), block, "left")
        kept = kept.withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(n_own, F.lit(1))))
        return kept.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n_other, F.lit(1)) - 1))).drop("_nq", "_nx")

    key = [block, "_qpart", "_part"]
    q, x = dealt(queries, "_qpart", "_nq", "_part", "_nx"), dealt(index, "_part", "_nx", "_qpart", "_nq")
    met = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(lambda a, b: closest.nearest(a, b, limit), f"id {q_id}, distance double, nearest {x_id}")
    best = met.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return best.select("id", F.col("m.nearest").alias("nearest"), F.col("m.distance").alias("distance"))


def cascade(items: DataFrame, evidence: list[tuple[str, DataFrame]], item_id: str, value: str) -> DataFrame:
    """The first source of evidence that has an item: value and method, in the order given."""
    out = items
    for name, table in evidence:
        out = out.join(table.select(item_id, F.struct(F.col(value), F.lit(name).alias("method")).alias(f"_{name}")), item_id, "left")
    first = F.coalesce(*[F.col(f"_{name}") for name, _ in evidence])
    return out.select(*items.columns, first[value].alias(value), F.coalesce(first["method"], F.lit("none")).alias("method"))


def inherit(elements: DataFrame, hosts: DataFrame) -> DataFrame:
    """Elements inside a host located by pixels take over its pages and method."""
    h = hosts.select(*KEYS, F.col("bbox"), F.col("ord"), F.col("candidate_pages").alias("host_pages"))
    pairs = elements.alias("a").join(h.alias("b"), _on("a", "b") & G.centre_in(F.col("a.bbox"), F.col("b.bbox")), "left")
    best = pairs.groupBy("a.doc_id", "a.element_id").agg(F.min_by("b.host_pages", "b.ord").alias("host_pages"))
    out = elements.join(best, ["doc_id", "element_id"], "left")
    taken = F.col("host_pages").isNotNull()
    return out.withColumn("candidate_pages", F.when(taken, F.col("host_pages")).otherwise(F.col("candidate_pages"))).withColumn("method", F.when(taken, "inside-preserved").otherwise(F.col("method"))).drop("host_pages")


def map_pages(rows: DataFrame, page_map: DataFrame) -> DataFrame:
    """source page to candidate pages; identity where no map has it. page_map: doc_id, page, candidate_pages."""
    return rows.join(page_map, ["doc_id", "page"], "left").withColumn("candidate_pages", F.coalesce("candidate_pages", F.array("page")))


def missing_terms(units: DataFrame, terms: DataFrame) -> DataFrame:
    """unit_id, term of units whose source has a term but whose target has neither its target nor a variant. A term without letters is never found."""
    t = terms.withColumn("cs", F.coalesce("case_sensitive", F.lit(False))).withColumn("needle", F.when(F.col("cs"), F.col("source")).otherwise(F.lower("source")))
    find = lambda cs, c: find_needles(units, "unit_id", c, t.where(F.col("cs") == cs)).withColumn("cs", F.lit(cs))
    hits = find(True, F.col("source")).unionByName(find(False, F.lower("source")))
    said = F.concat(F.array("target"), F.coalesce("allowed_variants", F.array().cast("array<string>")))
    pairs = hits.join(t.select("needle", "cs", F.col("source").alias("term"), said.alias("said")), ["needle", "cs"])
    own = units.select("unit_id", F.col("target").alias("text"))
    fold = lambda c: F.when(F.col("cs"), c).otherwise(F.lower(c))
    has = F.exists("said", lambda v: F.contains(fold(F.col("text")), fold(v)))
    return pairs.join(own, "unit_id").where(~F.coalesce(has, F.lit(False))).select("unit_id", "term")


def headings_near(headings: DataFrame, pages: DataFrame, reach: int = 1) -> DataFrame:
    """Headings found on their mapped page (0) or a neighbour (1), else null. headings: doc_id, page, text; pages: doc_id, page, text."""
    h = headings.withColumn("near", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)))
    p = pages.select("doc_id", F.col("page").alias("near"), F.col("text").alias("page_text"))
    hit = h.join(p, ["doc_id", "near"]).where(F.contains(X.probe_text(F.col("page_text")), X.probe_text(F.col("text"))))
    best = hit.groupBy("doc_id", "page", "text").agg(F.min(F.abs(F.col("near") - F.col("page"))).alias("offset"))
    return headings.join(best, ["doc_id", "page", "text"], "left")


def split_captions(edges: DataFrame, locations: DataFrame) -> DataFrame:
    """Captions whose pages share none with their target's. edges: doc_id, src_id, dst_id."""
    a = locations.select("doc_id", F.col("element_id").alias("src_id"), F.col("candidate_pages").alias("src_pages"))
    b = locations.select("doc_id", F.col("element_id").alias("dst_id"), F.col("candidate_pages").alias("dst_pages"))
    return edges.join(a, ["doc_id", "src_id"]).join(b, ["doc_id", "dst_id"]).where((F.size("src_pages") > 0) & (F.size("dst_pages") > 0) & ~F.arrays_overlap("src_pages", "dst_pages"))
