"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows, clashing columns and on an empty table."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, chat, components, htmltext, jaccardjoin, langid, linededup, mixing, quality, simhash, substrings
from leafmill.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, rep string"
LINE = "A shared line of some length"
BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    (1, BASE, "en", "s1"),
    (2, BASE, "en", "s1"),
    (3, BASE.replace("w60", "x60"), "en", "s1"),
    (4, None, None, None),
    (5, "", "en", "s2"),
    (6, f"{LINE}\nonly here, once\n{LINE}", "en", "s2"),
    (7, f"  {LINE.upper()}\t\nother things", "de", "s2"),
    (8, "word " * 30_000, "de", "s3"),
    (9, "two words", "de", None),
    (9, "two words", "de", None),
    (10, "#### %%%% 12 34", None, "s3"),
    (None, "a row without an id, quite alone", "en", "s1"),
    (11, "prefix here " + BASE + " and more", "fr", "s4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 0.5, "clash") for i, t, lang, s in TEXTS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(30)}}


def test_jaccard_join(spark, docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccardjoin.join(spark, docs).collect()), key=str)
    assert len(got) == len(TEXTS)
    by = {d: c for d, _, c in got}
    assert (by[1], by[2], by[3], by[11], by[4], by[None]) == (1, 1, 1, 1, 4, None)
    assert {(d, n) for d, n, _ in got if d in (4, 5, 9, 8)} == {(4, 0), (5, 0), (9, 1), (8, 1)}
    assert jaccardjoin.join(spark, none).count() == 0


def test_jaccard_join_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"v{rng.randrange(40)}" for _ in range(rng.randint(2, 60))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = "z"
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w := t.split()) >= 3 else {tuple(w)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in jaccardjoin.join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_line_dedup(spark, docs, none):
    rows = {r.doc_id: r for r in linededup.dedup_lines(docs).collect() if r.doc_id is not None}
    assert rows[6].text == TEXTS[5][1] and rows[6].n_dropped == 0
    assert (rows[7].text, rows[7].n_lines, rows[7].n_dropped) == ("other things", 2, 1)
    assert rows[2].text == "" and rows[2].n_dropped == 1 and rows[4].n_lines == 1 and rows[4].text == ""
    assert rows[3].ids == "clash"
    assert linededup.dedup_lines(none).count() == 0


def test_mixing(spark, docs, none):
    rows = mixing.plan(spark, docs).collect()
    assert len(rows) == len(TEXTS)
    total = sum(r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) <= own[0].target + max(r["size"] for r in own)
        assert own[0].target <= 2 * own[0].source_size + 1e-9 and all(r.taken <= 2 * r["size"] for r in own)
    assert sum(r.taken for r in rows) <= 1.5 * total + 1e-9
    assert mixing.plan(spark, none).count() == 0
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns


def test_mixing_takes_what_the_plan_takes_of_repeated_rows(spark):
    """Rows that repeat an id and size: the mix has as many words of each source as the plan."""
    rows = [(1, "one two three", "a")] * 7 + [(2, "four five six", "a")] * 4 + [(3 + i, "x y z w", "b") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.t for r in mixing.plan(spark, docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = {r.source: r.t for r in mixing.mix(spark, docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t")).collect()}
    assert {k: v for k, v in taken.items() if v} == got


def test_bpe(spark, docs, none):
    import public_tokenizers as P

    out = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(r.decoded == (r.text or "") for r in rows)
    d = {r.doc_id: r for r in bpe.digests(out).collect()}
    assert d[4].n_tokens == 0 and d[4].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_language_id(spark, docs, none):
    rows = langid.predictions(spark, docs).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 10)) and 0 <= r.score <= 1 for r in rows)
    assert langid.predictions(spark, none).count() == 0


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predictions(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert r.n > 200 and r.a > 0.97


def test_quality(spark, docs, none):
    rows = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert not rows[4].kept and rows[4].n_words == 0 and rows[4].base_failed
    assert rows[1].n_words == 120 and not rows[1].base_failed and not rows[8].kept and not rows[10].kept
    assert quality.assess(none).count() == 0


def test_simhash(spark, docs, none):
    rows = simhash.report(spark, docs).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(((i if i is not None else -(1 << 63), t or "") for i, t, *_ in TEXTS), key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        n, after = len(t), order[(k + 1) % len(order)][1]
        want.setdefault(None if i == -(1 << 63) else i, []).append(hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.edited_sha256)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    fp = {r.doc_id: r.fingerprint for r in rows}
    assert fp[1] == fp[2] and fp[4] == fp[5] == "0" * 16
    assert simhash.report(spark, none).count() == 0


def test_simhash_search_equals_brute_force(spark):
    import random

    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r["query"], r.fp) for r in simhash.near(df, df).collect()}
    assert got == {(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3}


def test_substrings(spark, docs, none):
    rows = substrings.dedup(spark, docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 11}
    assert {r.class_id for r in rows} == {1}
    assert any(r.doc_id == 11 and r.start_word <= 3 and r.n_words >= 118 for r in rows)
    assert substrings.dedup(spark, none).count() == 0


def test_substrings_recall_on_near_passages(spark):
    import random

    rng = random.Random(11)
    other = lambda n: [f"r{rng.getrandbits(40)}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(200):
        x = other(50)
        y = list(x)
        y[rng.randrange(4, 46)] = other(1)[0]
        a, b = (set(zip(*(z[j:] for j in range(5)), strict=False)) for z in (x, y))
        assert 0.8 <= len(a & b) / len(a | b) < 0.81
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(other(30) + x + other(30))), (2 * i + 1, " ".join(other(45) + y + other(20)))]
    out = substrings.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.partner_id) for r in out}
    assert found <= {p for a, b in pairs for p in ((a, b), (b, a))}
    assert sum((a, b) in found and (b, a) in found for a, b in pairs) >= 0.9 * len(pairs)


def test_substrings_components_equal_brute_force(spark):
    """Chains of texts of 50 words, each one word from the next: leaders of a list are not similar to all of it."""
    import random

    import numpy as np

    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"c{rng.getrandbits(40)}" for _ in range(50)]
        for at in rng.sample(range(4, 46), 8):
            words = [*words[:at], f"c{rng.getrandbits(40)}", *words[at + 1 :]]
            texts.append(" ".join(words))
    import pyarrow as pa

    seqs = [s for _, s in substrings.sequences(pa.array(texts), substrings.SHINGLE)]
    mins = [[int((s * seed).min()) for seed in substrings._SEEDS[: substrings.HASHES]] for s in seqs]
    keyed, like = list(range(len(texts))), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(np.intersect1d(seqs[i], seqs[j])) >= 41:  # 41 of 46: similarity 0.8
                like = [like[j] if r == like[i] else r for r in like]
                if sum(a == b for a, b in zip(mins[i], mins[j], strict=True)) >= substrings.ENOUGH:
                    keyed = [keyed[j] if r == keyed[i] else r for r in keyed]
    out = substrings.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert {i for i, r in enumerate(keyed) if keyed.count(r) > 1} <= set(got)
    for i in range(len(texts)):  # no link of a common key is lost, and no class joins what is not linked
        for j in range(i):
            if keyed[i] == keyed[j]:
                assert got[i] == got[j]
            if i in got and j in got and got[i] == got[j]:
                assert like[i] == like[j]


def test_substrings_leaves_unlike_texts_alone(spark):
    """One shingle many times, the same words in another order, and a shared line shorter than a passage."""
    import random

    rng = random.Random(3)
    other = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    five, words, line = other(5), other(120), other(40)
    mixed = words[:]
    rng.shuffle(mixed)
    texts = [other(50) + five + other(50), five * 100, words, mixed, *(other(60) + line + other(60) for _ in range(6))]
    assert substrings.dedup(spark, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).count() == 0


def test_substrings_finds_every_place(spark):
    import random

    rng = random.Random(7)
    other = lambda n: [f"p{rng.getrandbits(40)}" for _ in range(n)]
    shared, cycle = other(50), other(7)
    places, many = [], []
    for _ in range(15):
        many += other(100)
        places.append(len(many))
        many += shared
    texts = [many, other(60) + shared + other(60), cycle * 100, other(60) + cycle * 10 + other(60)]
    rows = substrings.dedup(spark, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    covered = {i: {p for r in rows if r.doc_id == i for p in range(r.start_word, r.start_word + r.n_words)} for i in range(4)}
    assert covered[0] == {p + k for p in places for k in range(50)}
    assert covered[1] == set(range(60, 110))
    assert covered[2] == set(range(700))
    assert covered[3] == set(range(60, 130))


def test_html(spark):
    rows = [(1, "http://a.com/1", "<body><nav>menu</nav><article><p>One &amp; two</p></article></body>"), (2, None, None), (None, "http://a.com/2", ""), (3, "no host", "text")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(spark, pages).collect()}
    assert got == {1: ("One & two", 9), 2: ("", 0), None: ("", 0), 3: ("text", 4)}
    assert htmltext.extract(spark, pages.limit(0)).count() == 0


def test_html_wrapper_from_all_pages_of_a_host(spark):
    """Hosts of three pages keep no boilerplate, and a text that one page of forty varies is no template."""
    page = lambda i, note: f"<body><article><p>Shared first line</p><h1>Title {i}</h1><p>{('w%d ' % i) * 30}</p><div>{note}</div></article></body>"
    rows = [(100 * h + i, f"http://h{h}.com/{i}", page(i, "Same note")) for h in range(12) for i in range(3)]
    rows += [(9000 + i, f"http://big.com/{i}", page(i, "Same note" if i else "One other note")) for i in range(40)]
    out = htmltext.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert "Shared first line" not in r.text
        assert ("note" in r.text) == (r.page_id >= 9000)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> & &amp; &lt;|"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "user\nx", "<|im_start|>")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.with_probe(spark, t)).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
    ex = chat.examples(chat.conversations(t)).where("conv_id = 1").orderBy("example").collect()
    assert [e.text[e.loss_start : e.loss_start + e.loss_chars] for e in ex] == ["a\nb", "a\nb"] and ex[1].text.startswith(ex[0].text)
    assert chat.digests(t.limit(0)).count() == 0
