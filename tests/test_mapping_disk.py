"""What the mapping and its settling write: one compressed table, no round, and a vector once or twice."""

import os

from pyspark.sql import functions as F

from leafmill.operators import mapping, metric
from leafmill.plans import queries_mapping
from leafmill.session import shared_dir


def _files(spark):
    root = shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}


def test_settling_writes_no_rounds(spark):
    rows = [(1, k, k, [k % 3 + 1, k % 3 + 2][: k % 2 + 1], 1.0) for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, element_id long, ord int, candidate_pages array<int>, confidence double")
    before = _files(spark)
    assert mapping.settle(frame).count() == 9
    assert _files(spark) == before


def test_a_comparison_of_mappings_writes_two_tables_in_parquet(spark, tmp_path):
    text = "\n".join(f"line {k} of a text with some words" for k in range(20))
    spark.createDataFrame([(d, text) for d in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = _files(spark)
    assert queries_mapping.mapping_drifted(spark, str(tmp_path)).count() > 0
    new = [f for f in _files(spark) - before if "/part-" in f and not f.endswith(".crc")]
    assert all(f.endswith(".parquet") for f in new) and len({os.path.dirname(f) for f in new}) == 2


def test_a_query_vector_is_sent_at_most_twice(spark):
    v = spark.range(50).select(F.lit(0).alias("g"), "id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("id") * k * 7 % 200).cast("double")).alias("v"))
    pivots = [[0.0] * 4, [200.0] * 2 + [0.0] * 2, [200.0, 0.0] * 2]
    plan = metric.candidates(v, v, 6.0, ["g"], pivots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
