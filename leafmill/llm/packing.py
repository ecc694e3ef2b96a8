"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

A document's tokens and one end token are cut only where they exceed a sequence; full pieces are sequences of their own. Pieces of equal length
are interchangeable, so a chromosome is a table of bins, each a tuple of lengths and how many sequences are filled
that way; its size follows the number of different lengths, never the number of documents.

Crossover injects whole well-filled bins of one parent into the other, removes bins that now hold documents twice,
and puts the displaced documents back best-fit, longest first. Mutation dissolves the worst-filled bins and some others. Islands are
Spark groups, each with a population of its own; after every epoch each island's elite migrates to the next. A packing
with as few sequences as the tokens need at least ends the search.

The plan then goes back to the pieces: those of a length are numbered over the whole table (a sort by range), and a
bin's sequences take consecutive numbers of each of its lengths.

Defined results: a null or empty text is its end token alone; rows with null or repeated ids are documents of their own; ties between
pieces of equal length follow (doc_id, piece, checksum), and equal ones are interchangeable; a text of any length is cut into pieces; an empty
table gives an empty result; other columns are not read. Reruns agree.
"""

from __future__ import annotations

import json
import os
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import ranks
from leafmill.llm import textkernel as K
from leafmill.llm.scratch import Scratch
from leafmill.llm.unitmemo import Memo, without_cycles

SEQUENCE = 2048
END = 0
ISLANDS = 4
MEMBERS = 6
EPOCHS = 3
GENERATIONS = 5
#: Kinds of bins that a chromosome may hold; beyond it the rarest kinds are dissolved and packed again.
KINDS = 8192
SEED = 7

Packing = dict[tuple[int, ...], int]


#: Words that a worker remembers, in two generations.
KNOWN = 400_000


class WordEncoder:
    """Token ids of texts, white space by white space: this tokenizer drops it, and no token goes across it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.memo = Memo(self._learn, KNOWN)
        shape = json.loads(self.tokenizer.to_str())
        self.split = regex.compile(shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        if not all(t["content"].startswith("<|") for t in shape["added_tokens"]):
            raise ValueError("special tokens are expected to begin with <|")
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # tokens that end a piece of the split pattern
        self.ends[[i for name, i in names.items() if name.endswith(shape["model"]["end_of_word_suffix"])]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _count(self, word: str) -> int:
        """Pieces of the split pattern in a word: each has one token that ends it."""
        return 1 if word.isascii() and word.isalpha() else len(self.split.findall(unicodedata.normalize("NFC", word).lower()))

    def _learn(self, words: list[str]) -> Iterator[bytes]:
        """One encoding of all words, cut by how many pieces each has; words that may hold a special token go alone."""
        plain = [w for w in words if "<|" not in w]
        ids = self._ids(" ".join(plain))
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        upto = np.cumsum([0, *map(self._count, plain)])
        if upto[-1] == len(ends) - 1:
            cut, data = (4 * ends[upto]).tolist(), ids.tobytes()
            found = iter([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
        else:  # another version of Unicode counts otherwise
            found = iter([self._ids(w).tobytes() for w in plain])
        for w in words:
            yield self._ids(w).tobytes() if "<|" in w else next(found)

    def _words(self, text: str | None) -> list[str]:
        """Words of a text, in lower case where that is sure to be the tokenizer's: Latin-1 without the beginning of a special token."""
        if not text:
            return []
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as unsigned 32-bit little-endian integers."""
        words = list(map(self._words, texts))
        known = self.memo.known(set().union(*words))
        return [b"".join(map(known.__getitem__, own)) for own in words]


_OWN: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _OWN:
        _OWN[path] = WordEncoder(path)
    return _OWN[path]


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm import packing

        own, tail = packing.encoder(path), end.to_bytes(4, "little")
        for batch in batches:
            raw, off = K.texts(batch.column(1))
            for lo, hi in K.parts(raw, off, 1 << 22):
                ids, texts, rows = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), []
                with packing.without_cycles():
                    encoded = own.encode(texts)
                for i, tokens in zip(ids, encoded, strict=True):
                    tokens += tail
                    for k, at in enumerate(range(0, len(tokens), 4 * size)):
                        part = tokens[at : at + 4 * size]
                        rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and on request ids (binary) of every document's pieces."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(path, size, end, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(loose: dict[int, int], bins: Packing, size: int, order: Iterable[int] | None = None) -> Packing:
    """`bins` with the loose documents (length: how many) put where least room is left, longest first unless an order is given."""
    room: dict[int, Packing] = {}
    done: Packing = {}
    for kind, n in bins.items():
        left = size - sum(kind)
        (room.setdefault(left, {}) if left else done)[kind] = n
    free = sorted(room)

    def put(kind: tuple[int, ...], n: int, left: int) -> None:
        if not left:
            done[kind] = done.get(kind, 0) + n
            return
        if left not in room:
            room[left] = {}
            insort(free, left)
        room[left][kind] = room[left].get(kind, 0) + n

    for length in order if order is not None else sorted(loose, reverse=True):
        n = loose.get(length, 0)
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                each = size // length
                if n >= each:
                    put((length,) * each, n // each, size - each * length)
                if n % each:
                    put((length,) * (n % each), 1, size - n % each * length)
                break
            left = free[at]
            kind, m = room[left].popitem()
            if not room[left]:
                del room[left], free[at]
            k = min(n, m)
            if m > k:
                put(kind, m - k, left)
            put(tuple(sorted((*kind, length), reverse=True)), k, left - length)
            n -= k
    for some in room.values():
        for kind, n in some.items():
            done[kind] = done.get(kind, 0) + n
    return done


def _take(kind: tuple[int, ...], n: int, left: dict[int, int]) -> int:
    """How many bins of a kind the documents that are left allow, n at most; they are taken away."""
    uses: dict[int, int] = {}
    for x in kind:
        uses[x] = uses.get(x, 0) + 1
    n = min(n, *(left[x] // k for x, k in uses.items()))
    if n:
        for x, k in uses.items():
            left[x] -= n * k
    return n


def crossover(one: Packing, other: Packing, counts: dict[int, int], size: int, rng: random.Random) -> Packing:
    """Well-filled bins of `other` go into `one` whole; bins of `one` that would hold documents twice go; displaced documents are fitted again."""
    by_fill = sorted(other, key=lambda kind: (size - sum(kind), kind))
    lead = by_fill[: max(1, len(by_fill) * rng.randint(1, 3) // 4)]
    start, stop = sorted((rng.randrange(len(lead)), rng.randrange(len(lead))))
    left, child = dict(counts), {}
    for kind in lead[start : stop + 1]:
        child[kind] = _take(kind, other[kind], left)
    for kind in sorted(one, key=lambda kind: (size - sum(kind), kind)):
        if n := _take(kind, one[kind], left):
            child[kind] = child.get(kind, 0) + n
    return best_fit(left, child, size)


def mutate(one: Packing, size: int, rng: random.Random) -> Packing:
    """The worst-filled bins and some others are dissolved and their documents fitted again, at times in a blurred order."""
    share, least, kept, loose = rng.choice((0.02, 0.1, 0.3)), rng.randint(0, size // 8), {}, {}
    for kind in sorted(one):
        if size - sum(kind) > least or rng.random() < share:
            for x in kind:
                loose[x] = loose.get(x, 0) + one[kind]
        else:
            kept[kind] = one[kind]
    noise = rng.choice((0, 0.02, 0.5))
    return best_fit(loose, kept, size, sorted(loose, key=lambda x: (-x * (1 + noise * rng.random()), x)))


def bounded(one: Packing, size: int, kinds: int = KINDS) -> Packing:
    """The same documents in at most about `kinds` kinds of bins."""
    if len(one) <= kinds:
        return one
    order = sorted(one, key=lambda kind: (-one[kind], kind))
    loose: dict[int, int] = {}
    for kind in order[kinds // 2 :]:
        for x in kind:
            loose[x] = loose.get(x, 0) + one[kind]
    packed = best_fit(loose, {}, size)
    for kind in order[: kinds // 2]:
        packed[kind] = packed.get(kind, 0) + one[kind]
    return packed


def cost(one: Packing, size: int) -> tuple[int, float]:
    """Sequences, then how evenly they are filled: a packing with some full and some nearly empty ones is the better start."""
    n = sum(one.values())
    return n, -sum(m * (sum(kind) / size) ** 2 for kind, m in one.items())


def first(counts: dict[int, int], size: int, rng: random.Random, noise: float) -> Packing:
    """Best-fit by length, longest first, the lengths blurred by up to `noise`."""
    return best_fit(counts, {}, size, sorted(counts, key=lambda x: (-x * (1 + noise * rng.random()), x)))


def _different(members: list[Packing]) -> list[Packing]:
    """Without members that repeat an earlier one."""
    out: list[Packing] = []
    for m in members:
        if m not in out:
            out.append(m)
    return out


def evolve(members: list[Packing], counts: dict[int, int], size: int, rng: random.Random, keep: int, generations: int = GENERATIONS) -> list[Packing]:
    """Some generations of one island, best first."""
    least = -(-sum(x * n for x, n in counts.items()) // size)
    members = sorted(members, key=lambda m: cost(m, size))
    for _ in range(generations):
        if cost(members[0], size)[0] <= least:
            break
        young = []
        for _ in range(keep // 2):
            one, other = members[min(rng.randrange(len(members)), rng.randrange(len(members)))], members[rng.randrange(len(members))]
            child = crossover(one, other, counts, size, rng)
            young.append(bounded(mutate(child, size, rng) if rng.random() < 0.5 else child, size))
        members = _different(sorted([*members, *young], key=lambda m: cost(m, size)))[:keep]
    return members[:keep]


_ISLAND = "island int, member int, n_bins long, kinds array<array<int>>, counts array<long>"


def _epoch(counts: dict[int, int], size: int, epoch: int, keep: int, seed: int):
    def run(key, frame):
        import pandas as pd

        from leafmill.llm import packing

        island = int(key[0])
        rng = random.Random(f"{seed}:{epoch}:{island}")
        frame = frame.sort_values("member")
        members = [{tuple(map(int, k)): int(n) for k, n in zip(r.kinds, r.counts, strict=True)} for r in frame.itertuples() if r.kinds is not None]
        if not members:
            members = [packing.first(counts, size, rng, noise) for noise in (0, 0.02 + 0.02 * island, 0.1, 0.2)[: keep - 1]]
        members = packing.evolve(members, counts, size, rng, keep)
        rows = [(island, i, sum(m.values()), [list(k) for k in m], list(m.values())) for i, m in enumerate(members)]
        return pd.DataFrame(rows, columns=["island", "member", "n_bins", "kinds", "counts"])

    return run


def search(spark: SparkSession, counts: dict[int, int], size: int, scratch: Scratch, islands: int = ISLANDS, epochs: int = EPOCHS, members: int = MEMBERS, seed: int = SEED) -> Packing:
    """The best packing that any island finds. counts: how many documents of each length; at most `size` entries."""
    if not counts:
        return {}
    least = -(-sum(x * n for x, n in counts.items()) // size)
    state = spark.createDataFrame([(i, 0, None, None, None) for i in range(islands)], _ISLAND)
    best = None
    for epoch in range(epochs):
        grown = state.repartition(islands, "island").groupBy("island").applyInPandas(_epoch(counts, size, epoch, members, seed), _ISLAND)
        grown = scratch.put(grown, f"epoch-{epoch}")
        best = grown.orderBy("n_bins", "member", "island").head()
        if best["n_bins"] <= least:
            break
        elite = grown.where("member = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("member", F.lit(members))
        state = grown.unionByName(elite)
    return {tuple(k): n for k, n in zip(best["kinds"], best["counts"], strict=True)}


def _table(bins: Packing) -> np.ndarray:
    """For each length of each kind of bin: length, first number taken, uses in a bin, first sequence, offset of its first use; sorted by (length, number)."""
    rows, taken, sequence = [], {}, 0
    for kind in sorted(bins, reverse=True):
        at = 0
        for x in sorted(set(kind), reverse=True):
            uses = kind.count(x)
            rows.append((x, taken.get(x, 0), uses, sequence, at))
            taken[x] = taken.get(x, 0) + uses * bins[kind]
            at += uses * x
        sequence += bins[kind]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.frombuffer(table.value, np.int64).reshape(-1, 5)
        key = (t[:, 0] << 48) | t[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = t[np.searchsorted(key, (length << 48) | number, "right") - 1]
            over = number - row[:, 1]
            columns = [*(batch.column(c) for c in names), pa.array(row[:, 3] + over // row[:, 2]), pa.array(row[:, 4] + over % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def plan(spark: SparkSession, parts: DataFrame, size: int = SEQUENCE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of a stored table of `pieces` with sequence_id and offset. What is collected and sent has a row for each length or kind of bin."""
    scratch = scratch or Scratch(spark, "packing")
    parts = parts.select("doc_id", "piece", "start", "length", "ids_crc32")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()}  # at most `size` rows
    whole = counts.pop(size, 0)
    bins = search(spark, counts, size, scratch)
    if whole:
        bins = {**bins, (size,): whole}
    order = ranks.placed(parts, [F.col("length"), F.asc_nulls_first("doc_id"), F.col("piece"), F.col("ids_crc32")], scratch, "order")
    order = ranks.ranked(order, ["length"], "number")
    sent = spark.sparkContext.broadcast(_table(bins).tobytes())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return order.mapInArrow(_placed(sent, parts.columns), schema)


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    scratch = Scratch(spark, "packing")
    return plan(spark, scratch.put(pieces(docs, path, size, end), "pieces"), size, scratch)


def sequences(spark: SparkSession, docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary, unsigned 32-bit little-endian), pieces (doc_id, piece, offset, length)."""
    scratch = Scratch(spark, "packing")
    parts = scratch.put(pieces(docs, path, size, end, with_ids=True), "pieces")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    nth = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    places = nth(plan(spark, parts, size, scratch)).alias("p")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*key, "_n"]]
    rows = places.join(nth(parts).alias("t"), same).select("p.sequence_id", F.struct("p.offset", "p.doc_id", "p.piece", "p.length", "t.ids").alias("x"))
    rows = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    ids = F.expr("aggregate(x, cast('' as binary), (acc, p) -> concat(acc, p.ids))")
    return rows.select("sequence_id", ids.alias("ids"), F.transform("x", lambda p: F.struct(p.doc_id, p.piece, p.offset, p.length)).alias("pieces"))
