"""nearest_bind looks for the nearest of every row."""

from leafmill.plans import queries_records


def test_every_row_is_a_query(spark, tmp_path):
    rows = [(i, [float(i % 2), 1.0 + i / 1000], 0) for i in range(1, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.id for r in queries_records.nearest_bind(spark, str(tmp_path)).collect()} == {2, 4, 6}  # the others have too little contrast
