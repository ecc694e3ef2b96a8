"""Importance resampling against a plain version and, on the smallest tables, against SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import queries, ranks, resample
from leafmill.llm import textkernel as K
from leafmill.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, n_features string, weight string, rank string, score double"


def plain(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def brute(docs, target):
    rows = [(i, *plain(t)) for i, t in docs]
    s, t = sum((c for _, _, c in rows), Counter()), sum((plain(x)[1] for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, n, c in rows:
        weight = sum(gain(b) * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {}
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        drawn.setdefault(r, []).append(k + 1)
    return sorted(((i, f, w, sc, drawn[(i, n, f, w, sc)].pop(0) if drawn.get((i, n, f, w, sc)) else None) for i, n, f, w, sc in out), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ09 _-é中\n\x00[`{", max_size=40), min_size=1, max_size=6))
def test_features(texts):
    raw, off = K.texts(pa.array(texts, pa.string()))
    at, grams = resample.features(raw, off)
    got = [Counter() for _ in texts]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    for firsts, crc in grams:
        for i, c in zip(firsts, crc, strict=True):
            got[owner[i]][int(c) % 10000] += 1
    assert got == [plain(x)[1] for x in texts]
    assert np.diff(at).tolist() == [plain(x)[0] for x in texts]


def test_long_words_go_on_in_another_kernel():
    texts = ["x" * 5000 + " short " + "é" * 400 + " end", "y" * 255 + " " + "z" * 256 + " " + "w" * 257]
    raw, off = K.texts(pa.array(texts, pa.string()))
    got = Counter(int(c) % 10000 for _, crc in resample.features(raw, off)[1] for c in crc)
    assert got == sum((plain(x)[1] for x in texts), Counter())


def test_resample(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = [(i, " ".join(words[(i * k + k // 3) % 8] for k in range(15 + i % 20))) for i in range(120)]
    docs += [(None, "no id " * 15), (7, docs[7][1]), (500, None), (501, ""), (502, "..."), (503, "long " * 40_000)]
    frame = spark.createDataFrame([(i, t, "clash", "clash", "clash", 0.5) for i, t in docs], DOC)
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "Theta eta")], "item_id long, text string")
    got = sorted(map(tuple, resample.resample(spark, frame, target).collect()), key=str)
    want = brute(docs, ["alpha beta gamma", None, "Theta eta"])
    assert got == want and sum(r[4] is not None for r in got) == 5 * sum(plain(t)[0] >= 20 for _, t in docs) // 100
    none = spark.createDataFrame([], DOC)
    assert resample.resample(spark, none, target).count() == 0
    assert len(resample.resample(spark, frame, none.select("text")).collect()) == len(docs)


def test_ranks_with_one_key_in_a_third_of_all_rows(spark):
    rows = [(5 if i % 3 == 0 else i % 50, i) for i in range(3000)]
    scratch = Scratch(spark, "t")
    frame = scratch.put(spark.createDataFrame(rows, "k long, i long"), "rows")
    out = ranks.ranked(ranks.placed(frame, [frame.k, frame.i], scratch, "order"), ["k"]).collect()
    seen = Counter()
    for k, i in sorted(rows):
        assert (k, i, seen[k]) in {(r.k, r.i, r["rank"]) for r in out if r.i == i}
        seen[k] += 1


@pytest.mark.parametrize("name", ["op13_importance_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == sorted(con.sql(queries.ORACLES[name]).fetchall())
