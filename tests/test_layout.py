"""Inversions, chains and payloads against plain versions; ties, nulls, rings, repeated rows and empty tables."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import chains, ordering, splice
from leafmill.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_inversions_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 9), rng.choice((None, 1, 2, 3, 4, 5))) for g in range(40) for _ in range(rng.randint(1, 15))]
    frame = spark.createDataFrame(rows, "g int, a int, b int")
    got = {r.g: (r.comparable, r.discordant) for r in ordering.inversions(frame, ["g"], "a", "b").collect()}
    want = {}
    for g in range(40):
        own = [(a, b) for h, a, b in rows if h == g and b is not None]
        pairs = [(p, q) for i, p in enumerate(own) for q in own[i + 1 :] if p[0] != q[0] and p[1] != q[1]]
        if pairs:
            want[g] = (len(pairs), sum((p[0] < q[0]) != (p[1] < q[1]) for p, q in pairs))
    assert got == want
    named = spark.createDataFrame([(1, "a", "z"), (1, "b", "y"), (1, "c", "y")], "g int, a string, b string")
    assert tuple(ordering.inversions(named, ["g"], "a", "b").first()) == (1, 2, 2)
    assert ordering.inversions(frame.limit(0), ["g"], "a", "b").count() == 0


def test_a_group_of_a_million_takes_n_log_n():
    values = np.random.default_rng(2).permutation(1_000_000)
    began = time.time()
    n = ordering.count_inversions(values, np.zeros(len(values), np.int64))[0]
    assert time.time() - began < 60 and abs(n / (1e12 / 4) - 1) < 0.01
    assert ordering.count_inversions(np.arange(1000)[::-1], np.zeros(1000, np.int64))[0] == 499_500


def test_chains_of_any_length(spark):
    rng = random.Random(3)
    want, edges = {}, []
    for d, size in enumerate((1, 2, 3, 64, 257, 1000)):
        names = rng.sample(range(100_000), size)
        edges += [(d, a, b) for a, b in zip(names, names[1:], strict=False)] + [(d, 200_000, None)]
        want |= {(d, x): (names[0], k) for k, x in enumerate(names) if size > 1}
    edges += [(9, 1, 2), (9, 2, 3), (9, 3, 1), (9, 5, 6)]
    want |= {(9, k): (None, None) for k in (1, 2, 3)} | {(9, 5): (5, 0), (9, 6): (5, 1)}
    frame = spark.createDataFrame(edges, "d int, a long, b long")
    got = {(r.d, r.a): (r.head, r["at"]) for r in chains.rank(frame, ["d"], "a", "b").collect()}
    assert got == want
    assert chains.rank(frame.limit(0), ["d"], "a", "b").count() == 0


BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
UNIT = f"doc_id long, unit_id string, ord int, page int, bbox {BOX}, kind string, source string, target string"


def test_continuations(spark):
    low, top = (50.0, 600.0, 300.0, 700.0), (50.0, 60.0, 300.0, 160.0)
    said = ("some words that go on", "target words")
    rows = [
        (1, "a", 1, 1, low, "Body", *said), (1, "n", 2, 1, (50.0, 740.0, 300.0, 760.0), "body", "12 a note", "x"), (1, "b", 1, 2, top, "body", *said),
        (1, "c", 2, 2, low, "body", "a sentence that ends. 12 ³", "t 12345"), (1, "d", 1, 3, top, "body", *said),
        (1, "e", 2, 3, (330.0, 600.0, 580.0, 700.0), "body", *said), (1, "f", 1, 4, top, "body", *said), (1, "g", 2, 4, low, "heading", *said), (1, "h", 1, 5, top, "body", *said),
        (1, "i", 2, 5, None, "body", *said), (1, "j", 1, 6, top, "body", *said), (2, "a", 1, 1, low, "body", None, None), (2, "b", 1, 2, top, "body", *said),
    ]
    pages = spark.createDataFrame([(d, p, 612.0, 792.0) for d in (1, 2) for p in range(1, 7)], "doc_id long, page int, width double, height double")
    got = {(r.unit_id, r.next_id) for r in chains.continuations(spark.createDataFrame(rows, UNIT), pages).collect()}
    assert got == {("a", "b"), ("e", "f")}


def covered(a, b):
    if not a:
        return 0.0
    return 1.0 if a in b else sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)


def plain_replaced(units, items):
    out = set()
    for doc, item, _, status, pages, regions, payload, method, anchor in items:
        if status != "ready":
            continue
        mine = [u for u in units if u[0] == doc]
        held = {u[1] for u in mine if u[4] and any(p == u[3] and x0 <= (u[4][0] + u[4][2]) / 2 <= x1 and y0 <= (u[4][1] + u[4][3]) / 2 <= y1 for p, (x0, y0, x1, y1) in regions or [])}
        seeds = held | {u[1] for u in mine if u[3] in pages and len(u[6]) >= 20 and len(payload) >= 20 and covered(u[6], payload) >= 0.9}
        if len(payload) < 20:
            out |= {(doc, item, u) for u in seeds}
            continue
        gone = set(seeds)
        for page in sorted(pages):
            own = sorted((u for u in mine if u[3] == page), key=lambda u: u[2])
            run = []
            for u in [*own, None]:
                if u and u[6] and covered(u[6], payload) >= 0.9:
                    run.append(u)
                    continue
                if sum(len(v[6]) for v in run) >= 20 and any(v[1] in seeds or "table" in v[5].lower() or "caption" in v[5].lower() for v in run):
                    gone |= {v[1] for v in run}
                run = []
            at = next((k for k, u in enumerate(own) if u[1] == anchor), None)
            span = at is not None and method in splice.SPAN_METHODS
            if span:
                gone -= {u[1] for u in own[:at] if u[1] not in held}
            places = [k for k, u in enumerate(own) if u[1] in gone]
            if places:
                for u in own[at if span else min(places) : max(places) + 1]:
                    if (span and not u[7]) or (len(u[6]) >= 2 and u[6] in payload):
                        gone.add(u[1])
        out |= {(doc, item, u) for u in gone}
    return out


UNITS = f"doc_id long, unit_id string, ord int, page int, bbox {BOX}, kind string, token string, keep_reason string"
ITEMS = f"doc_id long, item_id string, ord int, status string, pages array<int>, regions array<struct<page: int, bbox: {BOX}>>, token string, method string, anchor_id string"


def test_payloads_equal_a_plain_version(spark):
    rng = random.Random(4)
    words = ["alphabetical", "betaversion", "gamma", "delta", "epsilonepsilon", "z", "eta"]
    units, items = [], []
    for d in range(30):
        for k in range(14):
            box = (0.0, 10.0 * (k % 7), 50.0, 10.0 * (k % 7) + 8)
            token = "".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
            units.append((d, f"u{k:02}", k, k // 7 + 1, box if rng.random() < 0.9 else None, rng.choice(("body", "Table-cell", "caption")), token, rng.choice(("", None, "name"))))
        for i in range(2):
            page = rng.choice((1, 2))
            text = "".join(u[6] for u in units if u[0] == d and u[3] == page)
            cut = rng.randrange(max(1, len(text)))
            regions = [(rng.choice((1, 2)), (0.0, 10.0, 60.0, 30.0))] if rng.random() < 0.4 else None
            items.append((d, f"i{i}", i, rng.choice(("ready", "ready", "draft")), [page] if rng.random() < 0.7 else [1, 2], regions, text[cut : cut + 90], rng.choice(("manual", splice.SPAN_METHODS[0])), rng.choice((None, "u03", "u09", "none"))))
    u, i = spark.createDataFrame(units, UNITS), spark.createDataFrame(items, ITEMS)
    taken = splice.replaced(u, i)
    got = {tuple(r) for r in taken.collect()}
    assert got == plain_replaced(units, items) and len(got) > 50
    rows = sorted((r.doc_id, r.position, r.source, r.id, r.n_replaced) for r in splice.sequence(u, i, taken).collect())
    gone = {(d, x) for d, _, x in got}
    for d in range(30):
        own = [r for r in rows if r[0] == d]
        assert [r[1] for r in own] == list(range(1, len(own) + 1))
        assert [r[3] for r in own if r[2] == "unit"] == [f"u{k:02}" for k in range(14) if (d, f"u{k:02}") not in gone]
        assert {r[3]: r[4] for r in own if r[2] == "payload" and r[4]} == {j: n for j in ("i0", "i1") if (n := sum(x[0] == d and x[1] == j for x in got))}
    codes = {(r.doc_id, r.id, r.code) for r in splice.problems(u, i, taken).collect()}
    both = {(d, x) for d, x in gone if sum(y[0] == d and y[2] == x for y in got) > 1}
    assert {(d, x) for d, x, c in codes if c == "overlap"} == both
    assert {(d, j) for d, j, c in codes if c == "anchor-missing"} == {(x[0], x[1]) for x in items if x[3] == "ready" and x[8] == "none"}


def test_payloads_of_empty_tables(spark):
    u, i = spark.createDataFrame([], UNITS), spark.createDataFrame([], ITEMS)
    taken = splice.replaced(u, i)
    assert taken.count() == 0 and splice.sequence(u, i, taken).count() == 0 and splice.problems(u, i, taken).count() == 0
    one = spark.createDataFrame([(1, "u", 0, 1, None, None, None, None)], UNITS)
    assert [tuple(r) for r in splice.sequence(one, i, taken).select("source", F.col("id")).collect()] == [("unit", "u")]
