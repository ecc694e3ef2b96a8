from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import geom as G
from leafmill.operators import binding, corpus, gates, ordering, reconcile
from leafmill.plans import policy

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_boxes(spark):
    df = spark.createDataFrame([((10.0, 0.0, 0.0, 10.0), (5.0, 5.0, 15.0, 15.0))], f"a {BOX}, b {BOX}")
    a = G.box(F.col("a.x0"), F.col("a.y0"), F.col("a.x1"), F.col("a.y1"))
    r = df.select(a["x0"].alias("x0"), G.area(a).alias("area"), G.overlap(a, F.col("b")).alias("o"), G.distance(a, F.col("b")).alias("d")).first()
    assert (r.x0, r.area, r.o, r.d) == (0.0, 100.0, 25.0, 0.0)


def test_clusters_are_transitive(spark):
    rows = [(0, 1, i, (20.0 * i, 0.0, 20.0 * i + 10, 10.0)) for i in range(5)] + [(0, 1, 9, (500.0, 500.0, 510.0, 510.0))]
    got = ordering.cluster_boxes(spark.createDataFrame(rows, f"doc_id int, page int, drawing_no int, bbox {BOX}")).collect()
    assert {r.drawing_no: r.cluster for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}


def test_union_area(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)],)], f"b array<{BOX}>")
    assert df.select(A.union_area("b")).first()[0] == 7.0


def test_assignment(spark):
    df = spark.createDataFrame([(0, i) for i in range(7)], "g int, i int")
    got = ordering.assign(df, ["g"], ["i"], 3).groupBy("worker").count().orderBy("worker").collect()
    assert [r["count"] for r in got] == [3, 2, 2]


def test_binding_prefers_blocks_then_overlap(spark):
    units = spark.createDataFrame([(0, 1, "u1", [7], (0.0, 0.0, 1.0, 1.0)), (0, 1, "u2", [], (0.0, 0.0, 10.0, 10.0)), (0, 1, "u3", [], (90.0, 90.0, 99.0, 99.0))], f"doc_id int, page int, unit_id string, block_ids array<int>, bbox {BOX}")
    elements = spark.createDataFrame([(0, 1, "e1", 1, [7], (0.0, 0.0, 10.0, 10.0)), (0, 1, "e2", 2, [8], (0.0, 0.0, 10.0, 10.0))], f"doc_id int, page int, element_id string, ord int, block_ids array<int>, bbox {BOX}")
    got = {r.unit_id: (r.element_id, r.match) for r in binding.bind(units, elements).collect()}
    assert got == {"u1": ("e1", "block"), "u2": ("e2", "overlap"), "u3": (None, "orphan")}


def test_contract(spark):
    source = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, required boolean")
    plan = spark.createDataFrame([("a",), ("x",)], "id string")
    cand = spark.createDataFrame([("a", True, None), ("a", True, None), ("b", False, "because")], "id string, located boolean, omit_reason string")
    got = {(r.code, r.id) for r in reconcile.contract(source, plan, cand, ["legal"]).collect()}
    assert got == {("UNSOURCED_PLAN", "x"), ("UNPLANNED", "b"), ("MISSING", "b"), ("DUPLICATE", "a"), ("ILLEGAL_OMISSION", "b")}


def test_contract_meets_all_sides_in_one_shuffle_and_keeps_null_ids(spark):
    """Six joins once sorted the same rows again and again within a task."""
    source = spark.createDataFrame([("a", True), ("a", False), (None, True), ("d", None)], "id string, required boolean")
    plan = spark.createDataFrame([(None,), ("a",)], "id string")
    cand = spark.createDataFrame([(None, True, "legal"), (None, None, None), ("a", None, "legal"), ("z", True, None)], "id string, located boolean, omit_reason string")
    out = reconcile.contract(source, plan, cand, ["legal"])
    assert sorted((r.code, r.id or "") for r in out.collect()) == [("DUPLICATE", ""), ("MISSING", ""), ("UNKNOWN_CANDIDATE", ""), ("UNKNOWN_CANDIDATE", "z"), ("UNPLANNED", ""), ("UNSOURCED_PLAN", "")]
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan_text
    assert reconcile.contract(source, source, cand, ["legal"]).where("code = 'UNPLANNED'").count() == 1


def test_inversions(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 2), (0, 4, None)], "g int, a int, b int")
    assert tuple(ordering.inversions(df, ["g"], "a", "b").first()) == (0, 3, 1)


def test_pack(spark):
    rows = [(0, i, 4, True, i == 4) for i in range(10)]
    got = ordering.pack(spark.createDataFrame(rows, "d int, ord int, chars int, may_break boolean, is_heading boolean"), "d", 3, 100, 1, 1).orderBy("ord").collect()
    assert [r.batch for r in got] == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3]


def test_modes_without_events(spark):
    ev = spark.createDataFrame([("none", 1, True, 2.0), ("none", 1, False, 4.0)], "m string, run int, ok boolean, s double")
    modes = spark.createDataFrame([(m,) for m in gates.REVIEW_MODES], "m string")
    got = {r.m: r for r in gates.metric_summary(ev, modes, "m", F.col("run") == 1, F.col("ok"), F.col("s")).collect()}
    assert len(got) == 4 and got["none"].pass_rate == 0.5 and got["none"].median_seconds == 3.0 and got["precise"].pass_rate is None


def test_fallback(spark):
    levels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    r = spark.range(1).select(policy.next_level(levels, F.lit("b")), policy.next_level(levels, F.lit("c")), policy.next_level(levels, F.lit("zz")), policy.may_force(levels, F.lit("b"), F.lit("a"))).first()
    assert tuple(r) == ("c", None, "b", False)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert corpus.mark_duplicates(docs, "doc_id").count() == 0
    assert corpus.weighted_mode(docs, "source", "text", F.col("n_chars")).count() == 0


def test_search():
    assert ordering.first_that_fits([1, 2, 3, 4], lambda x: x >= 3) == 2
    assert ordering.first_that_fits([1, 2], lambda x: False) is None
    assert ordering.first_that_fits([], lambda x: True) is None


def test_nearest_of_one_block_is_spread_and_sends_vectors_as_given(spark):
    rows = [(i, [float((i * k) % 7) for k in range(1, 9)], 0) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, v array<float>, label int")
    out = binding.fingerprint_nearest(v.where("id % 10 = 0"), v, "label", 9.0, 0.0)
    want = {i: min((sum(abs(a - b) for a, b in zip(x, y)) / 8, j) for j, y, _ in rows if j != i)[::-1] for i, x, _ in rows if i % 10 == 0}
    assert {r.id: (r.nearest, r.distance) for r in out.collect()} == want
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()
