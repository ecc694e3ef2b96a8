"""nearest_bind: blocks are dealt into parts, and no pair of rows is sent."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.operators import binding, closest


def _plain(rows, limit):
    best = {}
    for i, x in rows:
        near = [(sum(abs(float(a) - float(b)) for a, b in zip(x, y)) / len(x), j) for j, y in rows if j != i]
        best[i] = min(near)
    return {i: m for i, m in best.items() if m[0] <= limit}


def test_parts_of_a_block_give_what_the_whole_gives(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("f4")]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, [1e6] + rows[3][1][1:]), (301, [float("nan")] * 6)]
    v = spark.createDataFrame([(i, x, 0) for i, x in rows] + [(400, rows[0][1], None)], "id long, v array<float>, label int")
    want = _plain(rows[:-1], 0.6)
    out = binding.fingerprint_nearest(v, v, "label", 0.6, 0.0, rows=40)
    assert {r.id: (r.distance, r.nearest) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]  # what follows the search sorts and joins no pairs


def test_equal_vectors_and_lengths():
    table = lambda rows: pa.table({"id": pa.array([i for i, _ in rows]), "v": pa.array([x for _, x in rows], pa.list_(pa.float64()))})
    rows = [(5, [1.0, 2.0]), (3, [1.0, 2.0]), (9, [1.0, 2.0]), (4, [1.0, 2.5, 8.0])]
    out = closest.nearest(table(rows), table(rows), 0.3).to_pydict()
    got = dict(zip(out["id"], zip(out["distance"], out["nearest"], strict=True), strict=True))
    assert got == {5: (0.0, 3), 3: (0.0, 5), 9: (0.0, 3), 4: (0.5 / 3, 3)}


def test_no_pairs_before_the_search(spark):
    v = spark.range(10).select("id", F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("v"), F.lit(0).alias("label"))
    plan = binding.fingerprint_nearest(v, v, "label", 1.0, 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
