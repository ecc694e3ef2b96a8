"""Every stage of the pipeline on nulls, empty and repeated rows, clashing columns and an empty table; and op6's verdict by its definition."""

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from leafmill.llm import quality

BASE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, rep string, lang_pred string"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("wordaa", "other"), "en", "b"),
    (4, None, None, None),
    (5, "", "de", "a"),
    (6, "12 34 ##", "de", "b"),
    (7, "Ein kurzer Satz über das Wetter\nund eine zweite Zeile", "de", None),
    (7, "Ein kurzer Satz über das Wetter\nund eine zweite Zeile", "de", None),
    (None, "a row without an id stands alone", "en", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 0.5, "clash", "clash") for i, t, lang, s in rows], DOC)


def test_stages(spark):
    docs = frame(spark, ROWS)
    kept = P.language_id(spark, docs, "").collect()
    assert {r.doc_id for r in kept} <= {1, 2, 3, 7, None} and all(r.lang != "clash" for r in kept)
    lines = {r.doc_id: r.text for r in P.line_dedup(spark, docs, "").collect()}
    assert lines[1] == BASE and lines[2] == "" and lines[6] == "12 34 ##"
    near = [r.doc_id for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(near, key=str) == sorted([1, 4, 5, 6, 7, 7, None], key=str)
    mixed = P.mix_sources(spark, docs, "")
    assert tuple(mixed.columns) == P.COLUMNS and {r.doc_id for r in mixed.collect()} <= {r[0] for r in ROWS}
    tokens = P.tokenize(spark, docs, "").collect()
    assert len(tokens) == len(ROWS) and all(r.round_trip for r in tokens)
    assert {r.n_tokens for r in tokens if r.doc_id in (4, 5)} == {0}


def test_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert tuple(docs.columns) == P.COLUMNS and docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, "").count() == 0


def test_verdict_is_the_conjunction_of_all_rules():
    texts = [r[1] for r in ROWS] + ["LOUD WORDS HERE " * 5, "what! no! stop! now! why? " * 4, "a b c d e f g h i j k l m", "line one is here\n" * 9, "##### " * 12, "same same same same other words go on and on here"]
    raw, off = quality.K.texts(pa.array(texts, pa.string()))
    part = quality.Part(raw, off)
    base = part.base()
    every = np.arange(len(texts))
    bad = base["base_failed"].copy()
    for rule in quality.RULES.values():
        bad |= rule(part, base, every)
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert quality.judge(part, order)["kept"].tolist() == (~bad).tolist()
    assert (~bad).any() and (bad & ~base["base_failed"]).any()
