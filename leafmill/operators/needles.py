"""Exact substring joins on minimizers.

A needle is known by one hash of a few of its characters: the least among the first of its windows. A text gives
the least hash of every run of windows, so each place where a needle stands gives that needle's hash, and equality of
hashes finds all candidates; `contains` then decides. Within a scope that happens in one step for each
group of it, else by a join. A text of n characters gives about n / 5 rows for needles of 16
characters or more. Needles from 4 characters use windows of 4, shorter ones all of their characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut

#: (least characters of a needle, characters of a window), longest first.
CLASSES = ((16, 8), (4, 4), (3, 3), (2, 2), (1, 1))
#: Hashes of needles that every task knows, as bits; texts give no rows for others. A fixed size: it prunes less where needles are very many.
BITS = 22
_U = np.uint64


def _windows(text: str, size: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(size):
        acc *= _U(0x9E3779B97F4A7C15)
        acc += codes[j : j + n] + _U(1)
    acc ^= acc >> _U(31)
    acc *= _U(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> _U(29))


def needle_key(text: str) -> tuple[int, int]:
    """Class and hash of a needle."""
    k, (least, size) = next((k, c) for k, c in enumerate(CLASSES) if len(text) >= c[0])
    return k, int(_windows(text[:least], size).min().astype(np.int64))


def text_keys(text: str, k: int) -> np.ndarray:
    """The hashes that needles of class k in this text can have."""
    least, size = CLASSES[k]
    h = _windows(text, size)
    run = least - size + 1
    if len(h) < run:
        return np.zeros(0, np.int64)
    if run > 1:
        h = np.lib.stride_tricks.sliding_window_view(h, run).min(axis=1)
    return np.unique(h).view(np.int64)


def _keyed_needles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [needle_key(x) for x in batch.column("needle").to_pylist()]
        columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([h for _, h in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_class", "_hash"])


def _keyed_texts(classes: list[int], bits):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.operators import needles

        known = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_v"]
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, kinds, hashes = [], [], []
                for i, v in enumerate(part.column("_v").to_pylist()):
                    for k in classes if v else ():
                        h = needles.text_keys(v, k)
                        slot = (h & ((1 << BITS) - 1)).astype(np.int64)
                        h = h[(known[slot >> 6] >> (slot & 63).astype(np.uint64)) & _U(1) == 1]
                        rows.append(np.full(len(h), i))
                        kinds.append(np.full(len(h), k, np.int32))
                        hashes.append(h)
                if rows:
                    kept = part.select(names).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes))], [*names, "_class", "_hash"])

    return run


def meet(texts: list[str], wanted: list[str]) -> Iterator[tuple[int, str]]:
    """Which needle stands in which text. Few or short ones are looked for one by one; else only where a key of the text is a needle's."""
    chars = sum(map(len, texts))
    if len(wanted) * (chars + 60 * len(texts)) <= 45_000 * len(wanted) + 400 * chars:  # nanoseconds, about
        yield from ((i, x) for i, v in enumerate(texts) for x in wanted if x in v)
        return
    known: dict[tuple[int, int], list[str]] = {}
    for x in wanted:
        known.setdefault(needle_key(x), []).append(x)
    hashes = {k: np.fromiter((h for c, h in known if c == k), np.int64) for k in {c for c, _ in known}}
    for i, v in enumerate(texts):
        for k, own in hashes.items():
            there = text_keys(v, k)
            yield from ((i, x) for h in there[np.isin(there, own)].tolist() for x in known[k, h] if x in v)


def _within(key: list[str], scope: list[str]):
    rest = [c for c in key if c not in scope]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.operators import needles

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts, asked = part.column("_texts"), part.column("_needles")
                rows, at, met = [], [], []  # of texts, of groups, needles
                ends = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                flat = texts.flatten()
                values = flat.field("_v").to_pylist()
                for g, (first, last, own) in enumerate(zip([0, *ends], ends, asked.to_pylist(), strict=False)):
                    for i, x in needles.meet(values[first:last], own):
                        rows.append(first + i)
                        at.append(g)
                        met.append(x)
                rows, at = pa.array(rows, pa.int64()), pa.array(at, pa.int64())
                columns = {c: part.column(c).take(at) for c in scope} | {c: flat.field(c).take(rows) for c in rest}
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in key), pa.array(met, pa.string())], [*key, "needle"])

    return run


def _find_within(v: DataFrame, key: list[str], needles: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Each group of the scope with its texts and needles is one row: what is sent grows as the input, and no key of a text is ever a row."""
    types = {f.name: f.dataType.simpleString() for f in v.schema}
    rest = [c for c in key if c not in scope]
    texts = v.where("_v <> ''").groupBy(*scope).agg(F.collect_list(F.struct(*rest, "_v")).alias("_texts"))
    asked = needles.where("needle <> ''").groupBy(*scope).agg(F.collect_set("needle").alias("_needles"))
    met = texts.join(asked, list(scope)).mapInArrow(_within(key, list(scope)), ", ".join(f"`{c}` {types[c]}" for c in key) + ", needle string")
    return met.distinct()


def find(texts: DataFrame, key: list[str], text: Column, needles: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """key columns, needle: the distinct needles that stand somewhere in each text.

    needles: the scope columns and `needle`; empty and null ones are left out. scope: columns of `key` that a needle and a text must share (a
    document, say); the texts and needles of one scope are met in one step. Without a scope texts are read twice. Texts are never multiplied by needles; a null
    or empty text holds nothing; texts that share a key count as one.
    """
    v = texts.select(*key, F.coalesce(text, F.lit("")).alias("_v"))
    if scope:
        return _find_within(v, key, needles, scope)
    wanted = needles.select("needle").where("needle <> ''").distinct()
    marked = cut(wanted.mapInArrow(_keyed_needles, "needle string, _class int, _hash long"))
    classes = sorted(r[0] for r in marked.select("_class").distinct().collect())  # three at most
    slot = F.col("_hash").bitwiseAND(F.lit((1 << BITS) - 1))
    words = marked.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_hash & 63 as int))")).alias("b")).collect()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        bits[r.w] = r.b
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    types = {f.name: f.dataType.simpleString() for f in v.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in key) + ", _class int, _hash long"
    met = v.mapInArrow(_keyed_texts(classes, sent), schema).join(marked, ["_class", "_hash"])
    asked = met.groupBy(*key).agg(F.collect_set("needle").alias("_needles"))  # so that a text is sent once, not for each needle
    return asked.join(v, key).select(*key, F.explode(F.filter("_needles", lambda x: F.contains("_v", x))).alias("needle")).distinct()
