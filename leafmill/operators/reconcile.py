"""Exact set reconciliation: expected against found, before against after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(sides: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """A row for each key of any side, with a boolean for each side: one shuffle for any number of sets."""
    parts = None
    for name, df in sides.items():
        p = df.select(*key, *[F.lit(1 if n == name else 0).alias(n) for n in sides])
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(*key).agg(*[(F.max(n) == 1).alias(n) for n in sides])


def contract(source: DataFrame, plan: DataFrame, candidate: DataFrame, legal: list[str], key: str = "id") -> DataFrame:
    """Problems of a render contract: code and id. source: id, required; plan: id; candidate: id, located, omit_reason.

    All sides meet in one grouped sum, so rows of an id are reduced before the only shuffle; null ids are no one's equal and have problems of their own.
    """
    why = F.col("omit_reason")
    marks = {
        "_known": ("source", F.lit(True)),
        "_need": ("source", F.col("required")),
        "_planned": ("plan", F.lit(True)),
        "_shown": ("candidate", F.lit(True)),
        "_located": ("candidate", F.col("located")),
        "_legal": ("candidate", why.isin(legal)),
        "_illegal": ("candidate", why.isNotNull() & ~why.isin(legal)),
    }
    parts = None
    for side, rows in {"source": source, "plan": plan, "candidate": candidate}.items():
        own = [(when if of == side else F.lit(False)).alias(name) for name, (of, when) in marks.items()]
        p = rows.select(key, *own, F.lit(int(side == "candidate")).alias("_n"))
        parts = p if parts is None else parts.unionByName(p)
    one = parts.groupBy(key).agg(*[F.coalesce(F.bool_or(name), F.lit(False)).alias(name) for name in marks], F.sum("_n").alias("_n"))
    has = lambda name: F.col(name) & F.col(key).isNotNull()
    found = {
        "UNSOURCED_PLAN": F.col("_planned") & ~has("_known"),
        "UNPLANNED": F.col("_need") & ~has("_planned"),
        "UNKNOWN_CANDIDATE": F.col("_shown") & ~has("_known"),
        "MISSING": F.col("_need") & ~has("_located") & ~has("_legal"),
        "DUPLICATE": F.col("_n") > 1,
        "ILLEGAL_OMISSION": F.col("_illegal"),
    }
    codes = F.array_compact(F.array(*[F.when(when, code) for code, when in found.items()]))
    return one.select(F.explode(codes).alias("code"), key)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def compare_rounds(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Each finding's fate: fixed, still or regression."""
    p = presence({"was": before, "is": after}, key)
    return p.select(*key, F.when(F.col("was") & F.col("is"), "still").when(F.col("was"), "fixed").otherwise("regression").alias("fate"))


def batch_results(expected: DataFrame, results: DataFrame, key: str = "unit_id") -> DataFrame:
    """missing, duplicate and foreign ids of a batch."""
    n = results.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("wanted")).distinct().join(n, key, "full_outer")
    code = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "foreign").when(F.col("n") > 1, "duplicate")
    return both.select(key, code.alias("code")).where("code is not null")


def publish(df: DataFrame, findings: DataFrame, path: str) -> bool:
    """All or nothing: written only if there is no finding."""
    if not findings.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def execution(plan: DataFrame, applied: DataFrame, document: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: unit counts of plan, application and document, pending batches, and whether all agree."""
    parts = None
    for name, df in {"planned": plan, "applied": applied, "document": document, "pending": pending}.items():
        p = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        parts = p if parts is None else parts.unionByName(p)
    one = parts.groupBy().pivot("name", ["planned", "applied", "document", "pending"]).agg(F.first("n"))
    return one.withColumn("agrees", (F.col("planned") == F.col("applied")) & (F.col("applied") == F.col("document")) & (F.col("pending") == 0))


def answer_problems(required: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """Each check's problem: unknown, duplicate, incomplete, fail, or null."""
    n = given.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and(F.col("answer") == "pass").alias("ok"))
    both = required.select(*key, F.lit(True).alias("wanted")).distinct().join(n, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "incomplete").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(~F.col("ok"), "fail")
    return both.select(*key, problem.alias("problem"))


def visual_gate(required: DataFrame, given: DataFrame, truncated: bool = False, stale: bool = False) -> DataFrame:
    """One row with the verdict: truncated, none, waiting, stale, unknown, duplicate, incomplete, fail or pass, in that order."""
    key = ["page", "element_id", "code"]
    p = answer_problems(required, given, key).groupBy().agg(
        F.count("*").alias("n"), *[F.count_if(F.col("problem") == x).alias(x) for x in ("unknown", "duplicate", "incomplete", "fail")]
    )
    w = required.agg(F.count("*").alias("wanted")).crossJoin(given.agg(F.count("*").alias("answers"))).crossJoin(p)  # three rows of one each
    verdict = (
        F.when(F.lit(truncated), "truncated")
        .when(F.col("wanted") == 0, "none")
        .when(F.col("answers") == 0, "waiting")
        .when(F.lit(stale), "stale")
    )
    for x in ("unknown", "duplicate", "incomplete", "fail"):
        verdict = verdict.when(F.col(x) > 0, x)
    return w.select("wanted", "answers", verdict.otherwise("pass").alias("verdict"))


def missing_values(required: Column, found: Column) -> Column:
    """Required anchors that the target lacks."""
    return F.array_sort(F.array_except(required, found))


def missing_links(required: Column, target: Column) -> Column:
    """URLs and DOIs by containment in the target without white space, so a line break loses none."""
    compact = F.lower(F.regexp_replace(F.coalesce(target, F.lit("")), r"(?U)\s+", ""))
    return F.filter(required, lambda x: ~F.contains(compact, F.lower(x)))


def merge_pages(a: Column, b: Column, route: Column) -> tuple[Column, Column]:
    """Union of two page lists, and the route: standard becomes hybrid if there is any page."""
    pages = F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<int>")), F.coalesce(b, F.array().cast("array<int>"))))
    return pages, F.when((F.size(pages) > 0) & (route == "standard-auto"), "hybrid-complex-pages").otherwise(route)


def followup_pages(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """Changed pages, their neighbours, and pages of the same type. pages: doc_id, page, type."""
    near = changed.select("doc_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    kinds = changed.join(pages, ["doc_id", "page"]).select("doc_id", "type").distinct()
    alike = pages.join(kinds, ["doc_id", "type"], "left_semi").select("doc_id", "page")
    return near.unionByName(alike).distinct().join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def merge_terms(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """New terms override old ones of the same source, case-insensitively."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    cols = old.columns
    best = both.groupBy(F.lower(key).alias("_k")).agg(F.max_by(F.struct(*cols), "_v").alias("t"))
    return best.select("t.*")


def percent_only(missing: DataFrame, found: DataFrame) -> DataFrame:
    """Missing values whose number is there, with or without the percent sign, are none. Columns: id, value."""
    bare = lambda c: F.regexp_replace(c, "%$", "")
    f = found.select("id", bare(F.col("value")).alias("_b")).distinct()
    return missing.withColumn("_b", bare(F.col("value"))).join(f, ["id", "_b"], "left_anti").drop("_b")
