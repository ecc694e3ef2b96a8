"""Kernels against brute force: words, BPE, compact windows, SimHash votes, quality counts, HTML, the network's gradients."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe, htmltext, jaccardjoin, langid, quality, simhash, substrings
from leafmill.llm import textkernel as K

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXT = st.text(alphabet="abcAB é漢😀 \n\t.,'1#", max_size=120)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words(texts):
    raw, off = K.texts(pa.array(texts, pa.string()))
    s, e, h, at = K.words(raw, off, lower=True)
    want = [w.encode() for t in texts for w in WORD.findall(t or "")]
    assert [bytes(raw[a:b]) for a, b in zip(s, e)] == want
    assert [int(x) for x in np.diff(at)] == [len(WORD.findall(t or "")) for t in texts]
    seen = {}
    for w, x in zip(want, h):
        assert seen.setdefault(w.lower(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_words_over_block_borders(monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    K._powers.cache_clear()
    texts = ["x" * 300, "a " * 100, "", "é漢 " * 40]
    raw, off = K.texts(pa.array(texts))
    s, e, h, _ = K.words(raw, off)
    assert [bytes(raw[a:b]).decode() for a, b in zip(s, e)] == [w for t in texts for w in WORD.findall(t)]
    K._powers.cache_clear()


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_codec():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


PIECES = st.lists(st.sampled_from(["a", "the", "  ", " ", "\n", "\n\n", "é", "漢", "'s", "'ll", "23", "\t", "\x1c", "\x85", "xxxxxxx", "😀", "!!", "ing", "<|endoftext|>"]) | st.text(max_size=6), max_size=30)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_bpe_equals_tiktoken_and_round_trips(codec, tiktoken_codec, pieces):
    text = "".join(pieces).encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tiktoken_codec.encode_ordinary(text)
    assert "".join(codec.decode(ids, 3)) == text


def test_bpe_forgets_without_harm(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "STATES", 5)
    other = bpe.Codec(codec.fst.ranks, codec.find.__self__.pattern)
    text = "several words here, some of them repeated here. several words"
    assert other.encode(text) == codec.encode(text) == other.encode(text)
    assert codec.encode(None) == codec.encode("") == b""


@given(st.binary(max_size=60), st.integers(1, 7))
def test_utf8_stream(data, step):
    stream = bpe.Utf8Stream()
    got = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.end()
    try:
        want = data.decode("utf-8")
    except UnicodeDecodeError:
        return
    assert got == want


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(3)
    for n in (5, 8, 30, 61):
        v = K.mix(rng.integers(0, 12, n).astype(np.uint64))  # with ties
        for t in (3, 5):
            seg = substrings.Segments([0], [0], [v])
            at = seg.centres(v, t)
            left, right = substrings.compact_windows(v, at, np.zeros(len(at), np.int64), np.full(len(at), n - 1))
            got = list(zip(left, at, right, strict=True))
            key = (v >> np.uint64(substrings._POS) << np.uint64(substrings._POS)) | np.arange(n, dtype=np.uint64)
            for i in range(n - t + 1):
                for j in range(i + t - 1, n):
                    c = i + int(np.argmin(key[i : j + 1]))
                    assert sum(1 for l, m, r in got if m == c and l <= i and j <= r) == 1


def test_overlaps_equal_brute_force():
    rng = random.Random(1)
    rows, n = [], 60
    for f in range(3):
        at = 0
        while at < n:
            a = at + rng.randint(0, 4)
            b = a + rng.randint(0, 8)
            rows.append((f, rng.getrandbits(60), a + 1, a, b))
            at = b + 1
    by = {f: tuple(np.array(x, np.uint64 if i == 0 else np.int64) for i, x in enumerate(zip(*(r[1:] for r in rows if r[0] == f)))) for f in range(3)}
    got = {(int(k), int(p)) for keys, _, first, last in substrings.overlaps(by, 2) for k, a, b in zip(keys, first, last) for p in range(a, b + 1)}
    want = 0
    for i in range(0, n + 20):
        have = sum(1 for r in rows if r[3] <= i <= r[4])
        want += have * (have - 1) // 2
    assert len(got) == want


def test_segments_keep_texts_apart():
    rng = np.random.default_rng(8)
    parts = [K.mix(rng.integers(0, 40, n).astype(np.uint64)) for n in (7, 4, 12, 5)]
    t = 4
    seg = substrings.Segments([0, 1, 2, 3], [0] * 4, parts)
    at = seg.centres(seg.seq, t).tolist()
    alone = [substrings.Segments([0], [0], [p]).centres(p, t) + seg.at[i] for i, p in enumerate(parts)]
    assert at == np.concatenate(alone).tolist()


def test_similar_windows_equal_brute_force():
    rng = np.random.default_rng(2)
    t = 6
    for _ in range(60):
        n = int(rng.integers(6, 40))
        x = rng.integers(0, 9, n).astype(np.uint64)
        y = np.where(rng.random(n) < 0.7, x, rng.integers(0, 9, n).astype(np.uint64))
        got = substrings.similar(x, y, np.arange(n), n, t, 0.8)[: n - t + 1]
        sets = [(set(x[i : i + t].tolist()), set(y[i : i + t].tolist())) for i in range(n - t + 1)]
        assert got.tolist() == [10 * len(a & b) >= 8 * len(a | b) for a, b in sets]
        z = np.unique(rng.integers(0, 1 << 40, n)).astype(np.uint64)
        rng.shuffle(z)
        w = np.roll(z, int(rng.integers(-2, 3)))
        w[rng.random(len(w)) < 0.1] = 1
        if len(z) >= t and not substrings.repeats(w, t)[-1]:
            pos = np.arange(len(z))
            plain, mx, my = substrings.similar_plain(z, w, pos, len(z), t, 0.6)
            assert (plain == substrings.similar(z, w, pos, len(z), t, 0.6))[: len(z) - t + 1].all()
            assert [a.tolist() for a in (mx, my)] == [a.tolist() for a in substrings._matched(z, w, pos, t)]
        rate, ok = substrings.against(x, y[:t], t, 0.8)
        fixed = sets[0][1]
        assert np.allclose(rate, [len(a & fixed) / len(a | fixed) for a, _ in sets])
        assert ok.tolist() == [10 * len(a & fixed) >= 8 * len(a | fixed) for a, _ in sets]


def test_leaders_compare_all_documents_of_a_list():
    key, doc = np.array([5, 5, 5, 5, 7, 7, 9]), np.array([4, 3, 3, 8, 1, 1, 2])
    c = np.array([10, 20, 30, 40, 1, 2, 3])
    order, lead, partner = substrings.led(key, doc, c, c)
    got = {(int(doc[order][i]), int(c[order][i]), int(doc[order][p]) if p >= 0 else None) for i, p in enumerate(partner)}
    assert got == {(3, 20, None), (3, 30, 4), (4, 10, 3), (8, 40, 3), (1, 1, None), (1, 2, None), (2, 3, None)}


def test_prefixes_lose_no_pair():
    rng = random.Random(5)
    for _ in range(300):
        base = rng.sample(range(10_000), rng.randint(1, 60))
        a, b = set(base), set(base)
        for s in (a, b):
            for _ in range(rng.randint(0, 4)):
                s.discard(rng.choice(base)) if rng.random() < 0.5 else s.add(rng.randrange(10_000))
        if not a or not b or 100 * len(a & b) < 90 * len(a | b):
            continue
        for la in range(1, 4):
            for lb in range(1, 4):
                if la > jaccardjoin.need(len(a), 90) or lb > jaccardjoin.need(len(b), 90):
                    continue
                pa_, pb = (sorted(s)[: len(s) - jaccardjoin.need(len(s), 90) + m] for s, m in ((a, la), (b, lb)))
                assert len(set(pa_) & set(pb)) >= min(la, lb)


def test_simhash_votes():
    texts = ["alpha beta beta gamma", "", None, "the quick brown fox " * 400]
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    for t, fp in zip(texts, got):
        votes = [0] * 64
        for w in WORD.findall((t or "").lower()):
            raw, off = K.texts(pa.array([w]))
            h = int(K.words(raw, off)[2][0])
            for bit in range(64):
                votes[bit] += (1 if h >> bit & 1 else -1) * min(len(w.encode()), 8) ** 2
        assert int(fp) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_masks_find_every_neighbour():
    rng = random.Random(2)
    masks = simhash.masks(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def _base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "b", "é#", "\n", "long", "  "]), max_size=60).map(" ".join), min_size=1, max_size=5))
def test_quality_base(texts):
    part = quality.Part(*K.texts(pa.array(texts, pa.string())))
    base = part.base()
    for i, t in enumerate(texts):
        assert tuple(int(base[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _base(t)
    order = list(quality.RULES)
    verdicts = [quality.judge(part, o)["kept"].tolist() for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    langid._F, old = np.float64, langid._F
    try:
        x = rng.integers(0, 256, (5, 4)).astype(np.uint8)
        y, mask = np.array([0, 1, 2, 1]), np.ones((5, 4))

        def loss():
            p = net.probabilities(x)
            return -np.log(p[:, y, np.arange(4)]).sum() / mask.sum()

        grad = net.gradients(x, y, mask)
        for name in net.p:
            for _ in range(4):
                at = tuple(rng.integers(0, s) for s in net.p[name].shape)
                if name.startswith("in"):
                    at = (at[0], int(x[rng.integers(0, 5), rng.integers(0, 4)]))
                keep = net.p[name][at]
                net.p[name][at] = keep + 1e-5
                up = loss()
                net.p[name][at] = keep - 1e-5
                down = loss()
                net.p[name][at] = keep
                assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5, name
    finally:
        langid._F = old


PAGE = (
    "<html><head><title>t</title><script>if (a < b) {}</script></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div>"
    "<div class=content><div class=post><h2>Title {i}</h2><div class=share>Share me</div><p>Paragraph {w} &amp; more &lt;x&gt;.</p><p><b>Second {i}<br>line"
    "<p>Third\n  {i}</div><div class=comments><p>Nice article {i} indeed, I liked it.</p></div></div><aside>Latest {i}</aside><form>Mail {i}</form><footer>c</footer>"
)


def test_wrapper():
    pages = [PAGE.replace("{i}", str(i)).replace("{w}", f"w{i} " * 30) for i in range(5)]
    wrapper = htmltext.infer(pages)
    for i, page in enumerate(pages):
        assert htmltext.read(page, wrapper) == f"Title {i}\nParagraph {('w%d ' % i) * 30}& more <x>.\nSecond {i} line\nThird {i}"
    assert htmltext.read(None, wrapper) == htmltext.read("", None) == ""
    assert htmltext.read("plain text, no tags", None) == "plain text, no tags"
    assert "+" in htmltext.expression(htmltext.template(htmltext.parse("<ul><li>a</li><li>b</li></ul>")))
