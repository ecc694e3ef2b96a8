"""What the near-duplicate join shuffles: only prefix shingles that two classes hold, each once; and how many rows go to Python at once."""

import numpy as np

import corpus_pipeline
from leafmill import session
from leafmill.llm import jaccardjoin


def texts() -> list[str]:
    alone = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(60)]
    near = [t.replace(f"w{i}x7 ", "other ") for i, t in enumerate(alone[:10])]
    return [*alone, *near, *alone[50:], "two words", "Two words", "", None]


def test_shingles_of_one_class_are_not_given_out(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    join = jaccardjoin.JaccardJoin(spark, docs, 5, 80)
    postings = join._postings().collect()
    sets = {r.rep: r.tokens for r in join.sets.collect()}
    assert {*range(10), *range(60, 70)} <= set(sets) and len(sets) < 23  # the bitmap may let a shingle through; copies are no classes of their own
    assert all(sum(r.token == p.token for r in postings) > 1 for p in postings)
    assert {t for v in sets.values() for t in v} >= {p.token for p in postings}
    whole = dict(enumerate(s for _, s in jaccardjoin._sets(docs.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0], 1, 5)))
    for p in postings:  # positions are those in the whole prefix
        order = np.lexsort((whole[p.rep], jaccardjoin.frequency(tuple(np.frombuffer(x, t) for x, t in zip(join.heavy.value, (np.uint64, np.int64), strict=True)), whole[p.rep])))
        assert whole[p.rep][order[p.pos]].view(np.int64) == p.token
    groups = {r.doc_id: r.component_id for r in jaccardjoin.join(spark, docs, 5, 80).collect()}
    want = {i: i for i in range(84)} | {60 + i: i for i in range(10)} | {70 + i: 50 + i for i in range(10)} | {81: 80}
    assert groups == want


def test_stages_send_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.tokenize):
            spark.conf.set(key, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(key)) == 1024
        spark.conf.set(key, "100")
        session.small_batches(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
