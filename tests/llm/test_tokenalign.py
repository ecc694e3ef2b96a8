"""Alignment of two tokenizers against a plain version, with counts sent to tasks and with counts joined."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import tokenalign

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, n_a string, groups string, links string, ends double"
TEXTS = ["plain words, don't split", "a  b", " x", "x ", "▁ y", "a\n\nb", "a\tb", "<|endoftext|> <s> </s> <unk>", "é à\nñ", "a b", "\n", "", None, "\nx", "emoji 😀 end", "x\0y z", "plain words, don't split", "word " * 3000 + "end"]


@pytest.fixture(scope="module")
def own():
    return tokenalign.Aligner(A, B)


def brute(own, text):
    """Groups and links from the ends of both sides' tokens."""
    if not text:
        return [], []
    data = (" " + text).encode()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    ab, bb = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
    if b"".join(ab) != data or b"".join(bb) != data:
        return [], []
    ends = {len(b"".join(bb[: j + 1])): j for j in range(len(b))} if len(b) < 500 else dict(zip(__import__("itertools").accumulate(map(len, bb)), range(len(b)), strict=True))
    at = i0 = j0 = 0
    groups, links = [], []
    for i, x in enumerate(ab):
        at += len(x)
        if at in ends:
            j = ends[at]
            groups.append((a[i0 : i + 1], b[j0 : j + 1]))
            links.append((a[i], b[j]))
            i0, j0 = i + 1, j + 1
    return groups, links


def expected(own, docs):
    found = [(i, *brute(own, t)) for i, t in docs]
    counts = Counter(x for _, _, links in found for x in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for i, groups, links in found:
        names = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sha = hashlib.sha256(names.encode()).hexdigest() if names else ""
        rows.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(rows, key=str)


def test_token_bytes_are_the_vocabularies(own):
    alphabet = tokenalign.byte_alphabet()
    assert len(alphabet) == 256 and alphabet["Ġ"] == 32 and alphabet["a"] == 97
    assert own.cuts and own.b_bytes[own.b.piece_to_id("<0x0A>")] == b"\n"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAS's.,1 \n\téß中😀▁<|> \r", max_size=30), min_size=1, max_size=5))
def test_shapes(own, texts):
    for text, (ends, names, links, n_a, n_b) in zip(texts, own.shapes(texts), strict=True):
        groups, want = brute(own, text)
        assert names == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()] == want
        assert (n_a, n_b) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))
        assert len(ends) == len(groups) and (not ends or ends[-1] == len((" " + text).encode()))


@pytest.mark.parametrize("lookup", [tokenalign.LOOKUP, 0])
def test_report(spark, own, lookup):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "plain words"), (None, "no id here")]
    frame = spark.createDataFrame([(i, t, "clash", "clash", "clash", 0.5) for i, t in docs], DOC)
    got = tokenalign.report(spark, frame, A, B, lookup=lookup)
    assert sorted(map(tuple, got.collect()), key=str) == expected(own, docs)
    assert tokenalign.report(spark, frame.limit(0), A, B, lookup=lookup).count() == 0


def test_report_on_the_smallest_table(spark, own):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    assert sorted(map(tuple, tokenalign.report(spark, frame, A, B).collect()), key=str) == expected(own, docs)


def test_align_keeps_other_columns(spark, own):
    frame = spark.createDataFrame([(i, t, "clash", "clash", "clash", 0.5) for i, t in enumerate(TEXTS)], DOC).withColumn("other", frame_lit())
    rows = tokenalign.align(frame, A, B).collect()
    assert all(r.other == "kept" for r in rows) and {r.doc_id: r.n_a for r in rows}[11] == 0


def frame_lit():
    from pyspark.sql import functions as F

    return F.lit("kept")


def test_memo_forgets_and_learns_again():
    from leafmill.llm.unitmemo import Memo

    asked = []
    memo = Memo(lambda xs: (asked.append(x) or x.upper() for x in xs), size=3)
    for wanted in ({"a", "b"}, {"b", "c", "d"}, {"e"}, {"a"}, {"f", "g", "h", "i"}, {"a", "b"}):
        known = memo.known(set(wanted))
        assert {x: known[x] for x in wanted} == {x: x.upper() for x in wanted}
    assert asked.count("b") > 1
