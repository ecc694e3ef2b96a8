"""Packing: pieces as the tokenizer gives them, whole and gapless sequences, as few as an exact search on small cases."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest

from leafmill.llm import packing
from leafmill.llm.scratch import Scratch

PATH = P.path("word_bpe_49k.json")
DOC = "doc_id long, text string, piece string, length string, sequence_id string"
ODD = ["a  b", " x ", "<|endoftext|>abc <|startoftext|>", "é à\nñ", "don't stop's it'S", "a b", "\n", "tab\tand\r\nmore", "emoji 😀 end", "x\0y z", "İstanbul ΑΣ ΣΑΣ.", "éa ̈b", "ﬁ ½ 12 345 6a7"]


@pytest.fixture(scope="module")
def direct():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers(direct):
    own = packing.WordEncoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode([*ODD, None, ""])]
        assert got == [direct(x)[:-1] for x in [*ODD, None, ""]]


def check(rows, ids, size):
    seen = defaultdict(list)
    for r in rows:
        seen[r.sequence_id].append((r.offset, r.length))
    for x in seen.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= size
    want = Counter((d, k, k * size, len(x[k * size :][:size]), zlib.crc32(np.array(x[k * size :][:size], "<u4").tobytes())) for d, x in ids for k in range(-(-len(x) // size)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    return len(seen)


def test_pack(spark, direct):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("one", "two", "antidisestablishmentarianism")) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(200 + i, x) for i, x in enumerate(ODD)] + [(7, docs[7][1])] * 3 + [(None, "no id"), (300, None), (301, ""), (302, "long " * 5000)]
    frame = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in docs], DOC)
    ids = [(i, direct(t)) for i, t in docs]
    n = check(packing.pack(spark, frame, PATH, size=64).collect(), ids, 64)
    total = sum(len(x) for _, x in ids)
    assert -(-total // 64) <= n <= 1.01 * -(-total // 64) + 1
    again = sorted(map(tuple, packing.pack(spark, frame, PATH, size=64).collect()), key=str)
    assert again == sorted(map(tuple, packing.pack(spark, frame.repartition(7), PATH, size=64).collect()), key=str)
    assert packing.pack(spark, frame.limit(0), PATH).count() == 0


def test_sequences_hold_the_tokens(spark, direct):
    docs = [(i, "some words " * (i % 9 + 1)) for i in range(40)] + [(3, "some words " * 4), (50, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = Counter()
    for r in packing.sequences(spark, frame, PATH, size=32).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == sum(p.length for p in r.pieces) <= 32
        for p in r.pieces:
            found[p.doc_id, p.piece, tuple(ids[p.offset : p.offset + p.length])] += 1
    want = Counter((d, k, tuple(x[32 * k : 32 * k + 32])) for d, t in docs for x in [direct(t)] for k in range(-(-len(x) // 32)))
    assert found == want


def least_bins(lengths, size):
    """Exact, over all subsets that fit in one bin."""
    full = (1 << len(lengths)) - 1
    fits = [m for m in range(1, full + 1) if sum(x for i, x in enumerate(lengths) if m >> i & 1) <= size]

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        low = left & -left
        return 1 + min(need(left & ~m) for m in fits if m & low and m & left == m)

    return need(full)


def test_search_equals_exact_on_small_cases(spark):
    rng = random.Random(5)
    for _ in range(25):
        lengths = [rng.randint(1, 20) for _ in range(9)]
        counts = dict(Counter(lengths))
        best = packing.evolve([packing.first(counts, 24, rng, x) for x in (0, 0.1, 0.3)], counts, 24, rng, 8, 40)[0]
        assert sum(best.values()) == least_bins(tuple(lengths), 24)
    counts = dict(Counter(rng.randint(1, 2047) for _ in range(3000)))
    best = packing.search(spark, counts, 2048, Scratch(spark, "t"), islands=2, epochs=2)
    assert Counter({x: sum(k.count(x) * n for k, n in best.items()) for x in counts}) == Counter(counts)
    assert sum(best.values()) <= packing.cost(packing.first(counts, 2048, rng, 0), 2048)[0]


def test_operators_keep_every_document():
    rng = random.Random(8)
    for _ in range(60):
        counts = {x: rng.randint(1, 50) for x in rng.sample(range(1, 64), 20)}
        a, b = packing.first(counts, 64, rng, 0.3), packing.first(counts, 64, rng, 0.6)
        for made in (packing.crossover(a, b, counts, 64, rng), packing.mutate(a, 64, rng), packing.bounded(a, 64, 5)):
            tally = Counter()
            for kind, n in made.items():
                assert sum(kind) <= 64 and n > 0
                for x in kind:
                    tally[x] += n
            assert tally == counts
