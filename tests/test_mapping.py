"""Substring joins, pivots and the mapping of elements against plain versions; nulls, ties, repeated rows and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import mapping, metric, needles
from leafmill.session import ship

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
ELEMENT = f"doc_id long, element_id string, ord int, type string, page int, bbox {BOX}, required boolean, content binary, text string, region_text string, fingerprint array<int>, n_drawings int"
PAGE = "doc_id long, page int, text string, n_drawings int"
IMAGE = f"doc_id long, page int, ord int, bbox {BOX}, content binary, fingerprint array<int>"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_every_place_of_a_needle_gives_its_key():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab é中😀") for _ in range(rng.randint(1, 90)))
        lo = rng.randrange(len(text))
        needle = text[lo : lo + rng.randint(1, 40)]
        k, h = needles.needle_key(needle)
        assert h in needles.text_keys(text, k).tolist()


def test_find_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [(i % 3, i, "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(0, 100, None), (0, 101, ""), (1, 4, "again abc")]
    wanted = [(d, t[lo : lo + n]) for d, _, t in texts if t for lo in (0, 3) for n in (1, 3, 4, 9, 16, 25)] + [(0, ""), (1, None), (2, "nowhere at all, not once")]
    frame = spark.createDataFrame(texts, "d long, i long, t string")
    ask = spark.createDataFrame(wanted, "d long, needle string")
    got = {tuple(r) for r in needles.find(frame, ["d", "i"], F.col("t"), ask, ("d",)).collect()}
    assert got == {(d, i, n) for d, i, t in texts if t for e, n in wanted if e == d and n and n in t}
    every = {(r.i, r.needle) for r in needles.find(frame, ["i"], F.col("t"), ask.select("needle")).collect()}
    assert every == {(i, n) for _, i, t in texts if t for _, n in wanted if n and n in t}
    assert needles.find(frame.limit(0), ["i"], F.col("t"), ask.select("needle")).count() == 0
    assert needles.find(frame, ["i"], F.col("t"), ask.select("needle").limit(0)).count() == 0


def test_meeting_is_the_same_one_by_one_and_by_keys():
    rng = random.Random(7)
    for chars, n in ((40, 5), (60_000, 400)):  # the second asks for keys
        texts = ["".join(rng.choice("abcde") for _ in range(chars)) for _ in range(3)] + [""]
        wanted = sorted({t[i : i + k] for t in texts if t for k in (1, 3, 4, 15, 16, 40) for i in rng.sample(range(chars), n // 5)} | {"nowhere"})
        got = list(needles.meet(texts, wanted))
        assert len(got) == len(set(got))
        assert set(got) == {(i, x) for i, t in enumerate(texts) for x in wanted if x in t}


def test_needles_of_a_document_are_met_without_a_row_for_each_key_of_its_text(spark):
    """The keys of all texts were once rows of a shuffle: more than the texts, as soon as needles filled the bitmap."""
    text = "".join(random.Random(8).choice("abcdefgh") for _ in range(3000))
    texts = spark.createDataFrame([(1, p, text) for p in range(4)], "d long, i long, t string")
    ask = spark.createDataFrame([(1, text[k : k + 20]) for k in range(0, 2900, 7)], "d long, needle string")
    found = needles.find(texts, ["d", "i"], F.col("t"), ask, ("d",))
    assert found.count() == 4 * ask.distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_hash" not in plan


def test_nearest_equals_brute_force_and_compares_few_pairs(spark):
    rng = random.Random(3)
    vectors = [(i % 2, i, [float(min(255, max(0, base + rng.randint(-9, 9)))) for base in [rng.choice((10, 90, 200))] * 8 for _ in [0]]) for i in range(400)]
    frame = spark.createDataFrame(vectors, "g long, id long, v array<double>")
    pivots = [[0.0] * 8, [255.0] * 4 + [0.0] * 4]
    q = frame.where("id < 100")
    got = {r.id: (r.distance, r.nearest.id) for r in metric.nearest(q, frame.where("id >= 100"), 6.0, ["g"], pivots, "id", ["id"]).collect()}
    want = {}
    for g, i, v in vectors[:100]:
        best = min(((sum(abs(a - b) for a, b in zip(v, w, strict=True)) / 8, j) for h, j, w in vectors[100:] if h == g), default=None)
        if best and best[0] <= 6:
            want[i] = best
    assert got == want and len(want) > 50
    n = metric.candidates(q, frame.where("id >= 100"), 6.0, ["g"], pivots).count()
    assert n < 100 * 300 / 2 / 2


def element(i, **over):
    row = {"doc_id": 1, "element_id": f"e{i}", "ord": i, "type": "body", "page": 1, "bbox": (0.0, 10.0 * i, 50.0, 10.0 * i + 8), "required": True, "content": None, "text": None, "region_text": None, "fingerprint": None, "n_drawings": None}
    return tuple((row | over).values())


def grid(seed, shift=0):
    rng = random.Random(seed)
    return [rng.randint(0, 200) + shift for _ in range(16)]


@pytest.fixture(scope="module")
def sides(spark):
    rows = [
        element(1, content=b"logo", type="raster-figure"),
        element(2, text="This sentence is on the second page of it"),
        element(3, text="common words on all pages"),
        element(4, fingerprint=grid(1), type="table", bbox=(0.0, 0.0, 90.0, 90.0), page=2),
        element(5, page=2, text="lost inside the region"),
        element(6, region_text="conv 64 x 64 relu 128", n_drawings=3, type="vector-figure"),
        element(7, n_drawings=2, type="chart"),
        element(8, n_drawings=9, type="chart"),
        element(9, text=" x "),
        element(10),
        element(11, text="never to be found anywhere"),
        element(12, fingerprint=[7] * 16, type="table", page=3),
        element(13, doc_id=2, text="This sentence is on the second page of it"),
        element(14, content=b"gone", fingerprint=grid(1, 4), type="raster-figure", page=3),
        element(15, bbox=None, required=None, text=None),
    ]
    pages = [(1, 1, "common words on all pages", 1), (1, 2, "This sen-\ntence is no match. This sentence is on the second page of it; common words on all pages", 2), (1, 3, "conv 64x64 and relu here, common words on all pages", 1), (1, 4, None, None), (2, 1, "other document", 0)]
    images = [(1, 2, 0, (1.0, 1.0, 5.0, 5.0), b"logo", None), (1, 4, 1, None, b"logo", None), (1, 3, 2, (2.0, 2.0, 6.0, 6.0), b"", grid(1, 3)), (1, 4, 3, (3.0, 3.0, 7.0, 7.0), None, grid(9)), (2, 1, 0, None, None, None)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return make(rows, ELEMENT), make(pages, PAGE), make(images, IMAGE)


def test_every_element_has_pages_method_and_confidence(spark, sides):
    got = {r.element_id: r for r in mapping.build(*sides, grid=4).collect()}
    shown = {k: (r.candidate_pages, r.method, r.confidence) for k, r in got.items()}
    assert shown == {
        "e1": ([2, 4], mapping.DIGEST, 1.0),
        "e2": ([2], mapping.SEARCH, 1.0),
        "e3": ([1, 2, 3], mapping.SEARCH, 0.33),
        "e4": ([3], mapping.PIXELS, 1.0),
        "e5": ([3], mapping.INSIDE, 0.9),
        "e6": ([3], mapping.ANCHOR, 0.75),
        "e7": ([2], mapping.DRAWINGS, 0.3),
        "e8": ([], mapping.NOT_FOUND, 0.0),
        "e9": ([], mapping.NO_EVIDENCE, 0.0),
        "e10": ([], mapping.NO_EVIDENCE, 0.0),
        "e11": ([], mapping.NOT_FOUND, 0.0),
        "e12": ([], mapping.NO_EVIDENCE, 0.0),
        "e13": ([], mapping.NOT_FOUND, 0.0),
        "e14": ([3], mapping.PIXELS, 1.0),
        "e15": ([], mapping.NO_EVIDENCE, 0.0),
    }
    assert (got["e6"].geometry_ok, got["e7"].geometry_ok, got["e4"].geometry_ok, got["e2"].geometry_ok) == (False, True, True, None)
    assert not got["e9"].required and got["e10"].required and got["e1"].candidate_bbox.x0 == 1.0 and got["e5"].candidate_bbox.x0 == 2.0
    codes = {(r.element_id, r.code) for r in mapping.verify(mapping.build(*sides, grid=4)).collect()}
    assert {("e1", "ambiguous"), ("e7", "drawings-only"), ("e6", "geometry-missing"), ("e10", "required-without-evidence"), ("e11", "missing-required"), (None, "visual-missing")} <= codes
    assert ("e9", "missing-required") not in codes
    total = {r.doc_id: (r.n_elements, r.n_located, r.complete) for r in mapping.summary(mapping.build(*sides, grid=4)).collect()}
    assert total == {1: (14, 8, False), 2: (1, 0, False)}


def test_empty_sides(spark, sides):
    e, p, i = sides
    assert mapping.build(e.limit(0), p, i, grid=4).count() == 0
    assert {r.method for r in mapping.build(e, p.limit(0), i.limit(0), grid=4).collect()} <= {mapping.NOT_FOUND, mapping.NO_EVIDENCE}
    assert mapping.settle(mapping.build(e.limit(0), p, i, grid=4)).count() == 0


def plain_settle(rows):
    """rows: (ord, pages, confidence) of one document."""
    open_, done, rounds = [list(p) for _, p, _ in rows], [p[0] if len(p) == 1 and c >= 0.9 else None for _, p, c in rows], [0 if len(p) == 1 and c >= 0.9 else None for _, p, c in rows]
    n = 0
    while True:
        n += 1
        before = list(done)
        for k in range(len(rows)):
            if before[k] is None:
                lo = max((x for x in before[:k] if x is not None), default=None)
                hi = min((x for x in before[k + 1 :] if x is not None), default=None)
                if (lo is None and hi is None) or (lo is not None and hi is not None and lo > hi):
                    continue
                fits = [p for p in open_[k] if (lo is None or lo <= p) and (hi is None or p <= hi)]
                if len(fits) == 1:
                    done[k], rounds[k] = fits[0], n
                if fits:
                    open_[k] = fits
        if done == before:
            return list(zip(done, rounds, strict=True))


def test_settle_equals_a_plain_version(spark):
    rng = random.Random(6)
    docs = {d: [(k, sorted(rng.sample(range(1, 9), rng.choice((0, 1, 1, 2, 3)))), rng.choice((0.5, 1.0))) for k in range(12)] for d in range(25)}
    docs[50] = [(0, [1], 1.0), (1, [1, 9], 0.5), (2, [2, 9], 0.5), (3, [3, 9], 0.5), (4, [3], 1.0)]
    frame = spark.createDataFrame([(d, f"{k:02}", k, p, c) for d, rows in docs.items() for k, p, c in rows], "doc_id long, element_id string, ord int, candidate_pages array<int>, confidence double")
    got = {(r.doc_id, r.ord): (r.settled_page, r.settled_round) for r in mapping.settle(frame).collect()}
    assert got == {(d, k): x for d, rows in docs.items() for k, x in enumerate(plain_settle(rows))}
    assert max(r or 0 for _, r in got.values()) >= 1


def test_differences_name_each_field(spark, sides):
    e, p, i = sides
    now = mapping.build(e, p, i, grid=4)
    assert mapping.differences(now, now).count() == 0
    other = mapping.build(e.where("element_id <> 'e3'"), p.where("page <> 2 or doc_id <> 1"), i, grid=4)
    got = {(r.element_id, r.field) for r in mapping.differences(now, other).collect()}
    assert {("e3", "element"), ("e2", "candidate_pages"), ("e2", "method"), ("e2", "confidence")} <= got and ("e4", "method") not in got
