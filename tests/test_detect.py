"""Footnotes, figures and tables against plain versions; ties, nulls, empty tables, any order of rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from leafmill.operators import detect, footnotes
from leafmill.session import ship

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
BLOCK = f"doc_id int, page int, block_id int, ord int, bbox {BOX}, text string, font_size double, furniture boolean"
DRAWING = f"doc_id int, page int, drawing_no long, bbox {BOX}"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def longest(a, b):
    """Size of the largest order-preserving matching, over all choices."""
    for n in range(min(len(a), len(b)), 0, -1):
        if any([a[i] for i in p] == [b[j] for j in q] for p in combinations(range(len(a)), n) for q in combinations(range(len(b)), n)):
            return n
    return 0


def test_match_is_a_longest_order_preserving_matching():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("123") for _ in range(rng.randint(0, 6))] for _ in range(2))
        met = footnotes.match(a, b)
        assert all(a[i] == b[j] for i, j in met) and len(met) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(met, met[1:], strict=False))


def test_bind_markers(spark):
    rng = random.Random(2)
    sides = {(d, p): ([rng.choice("1234") for _ in range(rng.randint(0, 5))], [rng.choice("1234") for _ in range(rng.randint(0, 5))]) for d in range(3) for p in range(20)}
    frame = lambda k: spark.createDataFrame([(d, p, i, x) for (d, p), s in sides.items() for i, x in enumerate(s[k])] + [(9, 9, 0, None)], "doc_id int, page int, ord int, label string").repartition(3)
    got = footnotes.bind_markers(frame(0), frame(1)).collect()
    for (d, p), (a, b) in sides.items():
        own = [r for r in got if (r.doc_id, r.page) == (d, p)]
        assert sorted((r.marker_ord, r.entry_ord) for r in own if r.marker_ord is not None and r.entry_ord is not None) == footnotes.match(a, b)
        assert sorted(r.marker_ord for r in own if r.marker_ord is not None) == list(range(len(a)))
        assert sorted(r.entry_ord for r in own if r.entry_ord is not None) == list(range(len(b)))
    assert footnotes.bind_markers(frame(0).limit(0), frame(1).limit(0)).count() == 0


def test_entries(spark):
    rows = [(1, "before\n1 one\n more of it\n\n(2) two\r\n3. three"), (2, None), (3, ""), (4, "no number"), (5, "7  \n8 eight")]
    got = sorted(tuple(r) for r in footnotes.entries(spark.createDataFrame(rows, "id int, text string"), ["id"]).collect())
    assert got == [(1, 1, "1", "one more of it"), (1, 2, "2", "two"), (1, 3, "3", "three"), (5, 1, "8", "eight")]


def test_footnotes(spark):
    prose = "p" * 90
    blocks = [
        (1, 1, 1, 1, (0.0, 0.0, 9.0, 50.0), prose, 10.0, None), (1, 1, 2, 2, (0.0, 700.0, 9.0, 720.0), "1 a note", 10.0, False), (1, 1, 3, 3, (0.0, 720.0, 9.0, 730.0), "small print", 8.0, False),
        (1, 1, 4, 4, (0.0, 730.0, 9.0, 740.0), "2 header", 8.0, True), (1, 1, 5, 5, None, "3 no box", 8.0, False), (1, 1, 6, 6, (0.0, 740.0, 9.0, 750.0), "  ", 8.0, False), (1, 1, 7, 7, (0.0, 650.0, 9.0, 720.0), "1 too high", 8.0, False),
        (1, 2, 1, 1, (0.0, 0.0, 9.0, 50.0), prose, 10.0, False), (1, 2, 2, 2, (0.0, 700.0, 9.0, 720.0), "1 as large", 10.0, False), (1, 2, 3, 3, (0.0, 700.0, 9.0, 720.0), "* small", 9.0, False), (1, 2, 4, 4, (0.0, 700.0, 9.0, 720.0), "small only", 9.0, False),
    ]
    drawings = [(1, 1, 1, (50.0, 690.0, 150.0, 691.0)), (1, 1, 2, (50.0, 600.0, 500.0, 601.0)), (1, 1, 3, (50.0, 720.0, 90.0, 721.0)), (1, 2, 1, None)]
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 2, 612.0, 792.0)], "doc_id int, page int, width double, height double")
    got = {(r.page, r.block_id, r.confidence) for r in footnotes.detect(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(drawings, DRAWING), pages).collect()}
    assert got == {(1, 2, 0.95), (1, 3, 0.75), (2, 3, 0.8)}


def test_grow_equals_a_plain_fixpoint(spark):
    rng = random.Random(3)
    make = lambda size: tuple(sorted((float(x), float(x + rng.randint(1, size))))[0:2] for x in (rng.randint(0, 500), rng.randint(0, 500)))
    box = lambda size: (lambda a: (a[0][0], a[1][0], a[0][1], a[1][1]))(make(size))
    figures = [(d, p, box(60)) for d in (1, 2) for p in range(6) for _ in range(6)] + [(1, 0, None)]
    labels = [(d, p, box(40)) for d in (1, 2) for p in range(6) for _ in range(25)]
    labels += labels[:3]

    def plain(own, tags, gap):
        regions, free = [(b, 1, 0) for b in own], list(tags)
        touch = lambda a, b: a[0] - gap <= b[2] and a[2] + gap >= b[0] and a[1] - gap <= b[3] and a[3] + gap >= b[1]
        union = lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        changed = True
        while changed:
            changed = False
            for i in range(len(regions)):
                for t in [t for t in free if touch(regions[i][0], t)]:
                    free.remove(t)
                    regions[i], changed = (union(regions[i][0], t), regions[i][1], regions[i][2] + 1), True
                k = next((k for k in range(len(regions)) if k != i and touch(regions[i][0], regions[k][0])), None)
                if k is not None:
                    a, b = regions[i], regions[k]
                    regions = [r for j, r in enumerate(regions) if j not in (i, k)] + [(union(a[0], b[0]), a[1] + b[1], a[2] + b[2])]
                    changed = True
                    break
        return sorted(regions)

    for gap in (0.0, 9.0):
        f = spark.createDataFrame(figures, f"doc_id int, page int, bbox {BOX}").repartition(5)
        got = {}
        for r in detect.grow(f, spark.createDataFrame(labels, f"doc_id int, page int, bbox {BOX}"), gap).collect():
            got.setdefault((r.doc_id, r.page), []).append((tuple(r.bbox), r.n_figures, r.n_labels))
        want = {(d, p): plain([b for e, q, b in figures if (e, q) == (d, p) and b], [b for e, q, b in labels if (e, q) == (d, p)], gap) for d in (1, 2) for p in range(6)}
        assert {k: sorted(v) for k, v in got.items()} == want
    assert detect.grow(f.limit(0), f.limit(0)).count() == 0


def test_vector_figures_need_many_drawings_and_area(spark):
    boxes = [(1, 1, i, (100.0 + 20 * (i % 3), 100.0 + 20 * (i // 3), 118.0 + 20 * (i % 3) + 60, 150.0 + 20 * (i // 3))) for i in range(6)]
    boxes += [(1, 2, i, (10.0, 10.0 + i, 600.0, 11.0 + i)) for i in range(8)] + [(1, 3, i, (10.0, 10.0, 12.0, 400.0)) for i in range(3)] + [(1, 1, 99, None)]
    pages = spark.createDataFrame([(1, p, 300.0, 400.0) for p in (1, 2, 3)], "doc_id int, page int, width double, height double")
    got = detect.vector_figures(spark.createDataFrame(boxes, DRAWING), pages).collect()
    assert [(r.page, r.figure_no, r.n_drawings, r.n_solid) for r in got] == [(1, 0, 6, 6)]
    assert got[0].confidence == round(0.6 + 6 / 200 + min(0.5, 118 * 70 / 120_000) * 0.5, 4)


def test_tables(spark):
    rule = lambda p, n, y, x1=300.0: (1, p, n, (50.0, y, x1, y + 1))
    drawings = [rule(1, 1, 100.0), rule(1, 2, 150.0), rule(1, 3, 300.0), rule(2, 1, 100.0), rule(2, 2, 150.0, 200.0), rule(3, 1, 100.0), rule(3, 2, 200.0)]
    block = lambda p, i, y, t: (1, p, i, i, (60.0, y, 200.0, y + 10), t, 10.0, False)
    blocks = [block(1, 1, 80.0, "Table 1: parts"), block(1, 2, 120.0, "a  b\nc  d"), block(1, 3, 200.0, "e"), block(2, 1, 80.0, "TABLE IV"), block(2, 2, 300.0, "text"), block(3, 1, 500.0, "表 3"), (1, 3, 9, 9, None, "Table 9", 10.0, False)]
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in (1, 2, 3)], "doc_id int, page int, width double, height double")
    b, d = spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(drawings, DRAWING)
    got = sorted((r.page, r.n_rules, r["rows"], r.columns, r.block_ids, r.caption_block_id, r.confidence) for r in detect.tables(b, d, pages).collect())
    assert got == [(1, 3, 3, 2, [2, 3], 1, 0.97), (2, 0, 0, 0, [1], 1, 0.45), (3, 0, 0, 0, [1], 1, 0.45)]
    assert detect.tables(b.limit(0), d.limit(0), pages).count() == 0


def test_lattice_finds_spans_of_random_tables(spark):
    rng = random.Random(4)
    cells, want = [], {}
    for t in range(40):
        n, m = rng.randint(3, 6), rng.randint(2, 5)
        xs = [0]
        for _ in range(m):
            xs.append(xs[-1] + rng.randint(40, 90))
        taken, k = set(), 0
        merged = (0, rng.randint(0, m - 2), 1, rng.randint(2, m)) if rng.random() < 0.6 else None
        if rng.random() < 0.4:
            tall = (rng.randint(1, n - 2), rng.randint(0, m - 1), 2, 1)
        else:
            tall = None
        for r, c, rs, cs in [x for x in (merged, tall) if x] + [(r, c, 1, 1) for r in range(n) for c in range(m)]:
            cs = min(cs, m - c)
            own = {(r + i, c + j) for i in range(rs) for j in range(cs)}
            if own & taken:
                continue
            taken |= own
            cells.append((1, 1, t, k, (xs[c] + 4.0, 20.0 * r + 2, xs[c + cs] - 4.0, 20.0 * (r + rs) - 2)))
            want[t, k] = (r, rs, c, cs)
            k += 1
    frame = spark.createDataFrame([*cells, (1, 1, 99, 0, None)], f"doc_id int, page int, region int, ord int, bbox {BOX}").repartition(4)
    rows = detect.lattice(frame).collect()
    assert {(r.region, r.ord): (r.row_no, r.row_span, r.column_no, r.column_span) for r in rows} == want
    heads = {r.region: max(x.row_no for x in rows if x.region == r.region and x.header) for r in rows}
    assert all(heads[t] == (1 if any(v[3] > 1 and v[0] == 0 for (u, _), v in want.items() if u == t) else 0) for t in heads)


def test_growing_leaves_no_tables_behind_and_takes_many_pages_at_once(spark, tmp_path):
    """Rounds once wrote a checkpoint each; a chain of labels between figures needs many."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    try:
        figures = [(1, p, (0.0, 0.0, 1.0, 1.0)) for p in range(40)] + [(1, p, (100.0, 0.0, 101.0, 1.0)) for p in range(40)]
        labels = [(1, p, (2.0 * i, 0.0, 2.0 * i + 1, 1.0)) for p in range(40) for i in range(1, 50) if p % 2 or i != 25]
        make = lambda rows: spark.createDataFrame(rows, f"doc_id int, page int, bbox {BOX}")
        got = {}
        for r in detect.grow(make(figures), make(labels), 1.0).collect():
            got.setdefault(r.page, []).append((tuple(r.bbox), r.n_figures, r.n_labels))
        for p in range(40):
            want = [((0.0, 0.0, 101.0, 1.0), 2, 49)] if p % 2 else [((0.0, 0.0, 49.0, 1.0), 1, 24), ((52.0, 0.0, 101.0, 1.0), 1, 24)]
            assert sorted(got[p]) == want
        assert not [x for x in tmp_path.rglob("*") if x.is_file()]
    finally:
        spark.sparkContext.setCheckpointDir(before)


def test_boxes_of_many_pages_connect_as_in_a_union_find():
    from leafmill.operators import boxes

    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(60), rng.integers(0, 40, 60))
    x, y = rng.integers(0, 200, (2, len(group))).astype(float)
    box = np.stack([x, y, x + rng.integers(0, 20, len(x)), y + rng.integers(0, 20, len(x))])
    box[:, 5] = np.nan
    want = list(range(len(group)))
    for i in range(len(want)):
        for j in range(i):
            if group[i] == group[j] and box[0, i] - 3 <= box[2, j] and box[2, i] + 3 >= box[0, j] and box[1, i] - 3 <= box[3, j] and box[3, i] + 3 >= box[1, j]:
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    for pairs in (boxes.PAIRS, 3):
        boxes.PAIRS, kept = pairs, boxes.PAIRS
        try:
            assert boxes.connected(group, box, 3.0).tolist() == want
        finally:
            boxes.PAIRS = kept


def test_entries_are_cut_without_a_shuffle(spark):
    """Lines were once exploded, sorted in a window and gathered again."""
    text = " lead\n1. one\r\n goes  on \n\n(2) two\r3)\n12 a 4 b\nend"
    notes = spark.createDataFrame([(1, text), (2, None), (3, "none here")], "k int, text string")
    out = footnotes.entries(notes, ["k"])
    got = [tuple(r) for r in out.orderBy("k", "entry").collect()]
    assert got == [(1, 1, "1", "one goes  on"), (1, 2, "2", "two 3)"), (1, 3, "12", "a 4 b end")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
