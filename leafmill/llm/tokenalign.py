"""Alignment of two tokenizers' tokens of the same text, and corpus-wide counts of the token pairs that end together.

A text gets one label a byte: nothing, a token of A ends here, a token of B ends here, or both. A regular expression
scans the label string for spans up to each both-label; how many A-end and B-end labels a span has says how many tokens
of either side form its group. The last tokens of a group end together: they are its link.

Where a single space or newline stands between two other characters, tokens of both vocabularies end (checked in the
vocabulary of B; the split pattern of A begins a match there), so a text is cut there, and pieces already seen are not
encoded again. A text with other white space, or with a piece whose bytes one side does not give back, goes whole.

Two passes over the texts: the first counts links over the corpus, the second adds up each document's groups and the
counts of its links. Pair counts are sent to every task as long as there are at most `LOOKUP` of them (16 bytes each);
beyond that documents send their links, summed, to a join.

Defined results: a text that is null, empty, or not given back byte for byte by both vocabularies has no tokens: zeros and an
empty string; rows with null or repeated ids are judged one by one; an empty table gives an empty result; a text is held whole in memory, with
its pieces; other columns pass through `align`, where columns with the names of its results are replaced, and are not read by `report`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import textkernel as K
from leafmill.llm.scratch import Scratch
from leafmill.llm.unitmemo import Memo, without_cycles

#: Most pairs that are sent to every task.
LOOKUP = 4_000_000
#: Different pairs that a task holds before it passes its counts on.
HELD = 500_000
#: Pieces of text that a worker remembers, in two generations.
KNOWN = 400_000
_LABELS = np.frombuffer(b".abx", np.uint8)
_SPAN = re.compile(rb"[ab]*x")
_ODD = re.compile(r"[^\S\n]|.\n|^\n?$|▁", re.S)
_EMPTY = (0, 0, 0, 0, 0, "")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, list[bytes]]:
    """Where each group of a text of `size` bytes ends, and its labels (those of bytes at which nothing ends are left out)."""
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] += 1
    labels[b_ends - 1] += 2
    return np.flatnonzero(labels == 3) + 1, _SPAN.findall(_LABELS[labels].tobytes().translate(None, b"."))


class Groups:
    """Groups of one text: token ids, where each group ends in bytes and in either token sequence."""

    def __init__(self, a: list[int], b: list[int], a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> None:
        self.a, self.b = a, b
        self.ends, found = spans(a_ends, b_ends, int(a_ends[-1]))
        n = np.array([s.count(b"a") for s in found], np.int64) + 1
        self.a_at, self.b_at = np.cumsum(n), np.cumsum(np.array([len(s) for s in found], np.int64) - n + 1)
        self.links = (a_ids[self.a_at - 1] << 32) | b_ids[self.b_at - 1]


class Aligner:
    """Both vocabularies of one worker. lookup: sorted pair keys, their counts, and whether each is the most frequent of its B id."""

    def __init__(self, a_path: str, b_path: str, lookup: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, names = byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.cuts = all("▁" not in p.lstrip("▁") and "\n" not in p[1:] for p in pieces)
        self.lookup = lookup
        self.links, self.sums, self.whole = Memo(self._links, KNOWN), Memo(self._sums, KNOWN), Memo(self._full)

    def groups(self, text: str) -> Groups | None:
        """Groups of space and text; None if it has no tokens."""
        if not text:
            return None
        data = (" " + text).encode("utf-8")
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        return Groups(a, b, a_ids, b_ids, np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]))

    def pieces(self, text: str) -> list[str]:
        """A text cut before each space and newline; the space before a piece is left out, a newline is not."""
        return (" " + text).replace("\n", " \n").split(" ")[1:]

    def _learn(self, pieces: list[str]) -> Iterator[tuple[Groups, int, int] | None]:
        """Groups and their range for each piece, from one encoding of all; None for a piece that can't be cut out."""
        good = [p for p in pieces if (p and p.isprintable() and "▁" not in p) or not _ODD.search(p)] if self.cuts else []
        found, at = self._joined(good), 0
        for p in pieces:
            if at < len(good) and good[at] is p:
                yield found[at]
                at += 1
            else:
                yield None

    def _joined(self, good: list[str]) -> list:
        if not good:
            return []
        text = "".join(["a", *(p if p[0] == "\n" else " " + p for p in good)])  # the first piece is not among those asked for
        out = self.groups(text)
        ends = 2 + np.cumsum([len(p.encode("utf-8")) + (p[0] != "\n") for p in good])
        if out is not None:
            cut = np.searchsorted(out.ends, ends)
            if (out.ends[np.minimum(cut, len(out.ends) - 1)] == ends).all() and out.ends[0] == 2:
                at = [1, *(cut + 1).tolist()]
                return [(out, at[k], at[k + 1]) for k in range(len(good))]
        if len(good) == 1:
            return [None]
        half = len(good) // 2
        return self._joined(good[:half]) + self._joined(good[half:])

    def _names(self, g: Groups) -> list[str]:
        """Ids of each group."""
        a, b = list(map(self.a_name.__getitem__, g.a)), list(map(self.b_name.__getitem__, g.b))
        out, i, j = [], 0, 0
        for x, y in zip(g.a_at.tolist(), g.b_at.tolist(), strict=True):
            out.append(f"{a[i] if x == i + 1 else ','.join(a[i:x])}|{b[j] if y == j + 1 else ','.join(b[j:y])}")
            i, j = x, y
        return out

    def _links(self, pieces: list[str]) -> Iterator[bytes | None]:
        for x in self._learn(pieces):
            yield x and x[0].links[x[1] : x[2]].tobytes()

    def _running(self, g: Groups) -> np.ndarray:
        """Before each group: tokens of A, of B, groups, links that are the most frequent of their B id, sum of counts."""
        out = np.zeros((len(g.links) + 1, 5), np.int64)
        out[1:, 0], out[1:, 1], out[:, 2] = g.a_at, g.b_at, np.arange(len(out))
        if self.lookup:
            keys, n, top = self.lookup
            at = np.searchsorted(keys, g.links)
            np.cumsum(top[at], out=out[1:, 3])
            np.cumsum(n[at], out=out[1:, 4])
        return out

    def _sums(self, pieces: list[str]) -> Iterator[tuple[bytes, str] | None]:
        """The five sums of a piece, as bytes, and the names of its groups."""
        for g, some in groupby(self._learn(pieces), lambda x: x and x[0]):
            if g is None:
                yield from some
                continue
            lo, hi = zip(*[x[1:] for x in some], strict=True)
            running, names = self._running(g), self._names(g)
            rows = (running[list(hi)] - running[list(lo)]).tobytes()
            for k, (a, b) in enumerate(zip(lo, hi, strict=True)):
                yield rows[40 * k : 40 * k + 40], ";".join(names[a:b])

    def _full(self, pieces: list[str]) -> Iterator[tuple | None]:
        """Size in bytes, ends of groups, names of groups, links, tokens of A and B."""
        last = names = None
        for x in self._learn(pieces):
            if x and x[0] is not last:
                last, names = x[0], self._names(x[0])
            yield x and self._shape(*x, names)

    @staticmethod
    def _shape(g: Groups, lo: int, hi: int, names: list[str]) -> tuple:
        start, i, j = (int(x[lo - 1]) if lo else 0 for x in (g.ends, g.a_at, g.b_at))
        ends = [e - start for e in g.ends[lo:hi].tolist()]
        return ends[-1], ends, ";".join(names[lo:hi]), g.links[lo:hi].tobytes(), int(g.a_at[hi - 1]) - i, int(g.b_at[hi - 1]) - j

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Link keys of some texts and how often each occurs."""
        pieces = [self.pieces(x) if x else [] for x in texts]
        times = Counter(chain.from_iterable(pieces))
        known = self.links.known(set(times))
        odd = {p for p in times if known[p] is None}
        keys, n = [], []
        if odd:
            for x, own in zip(texts, pieces, strict=True):
                if own and not odd.isdisjoint(own):
                    times.subtract(own)
                    if g := self.groups(x):
                        keys.append(g.links)
                        n.append(np.ones(len(g.links), np.int64))
            for p in odd:
                del times[p]
        links = list(map(known.__getitem__, times))
        keys.append(np.frombuffer(b"".join(links), np.int64))
        n.append(np.repeat(np.fromiter(times.values(), np.int64, len(times)), np.fromiter(map(len, links), np.int64, len(links)) // 8))
        return tally(np.concatenate(keys), np.concatenate(n))

    def report(self, texts: list[str]) -> Iterator[tuple]:
        """(tokens of A, tokens of B, groups, best links, sum of counts, groups as text) of each text."""
        pieces = [self.pieces(x) if x else [] for x in texts]
        at = dict.fromkeys(chain.from_iterable(pieces))
        known = self.sums.known(set(at))
        found = list(map(known.__getitem__, at))
        odd = {p for p, f in zip(at, found, strict=True) if f is None} if None in found else set()
        names = [f[1] if f else "" for f in found]
        numbers = np.frombuffer(b"".join([f[0] if f else bytes(40) for f in found]), np.int64).reshape(-1, 5)
        at = dict(zip(at, range(len(at)), strict=True))
        where = np.fromiter(map(at.__getitem__, chain.from_iterable(pieces)), np.int64)
        upto = np.zeros((len(where) + 1, 5), np.int64)
        np.cumsum(numbers[where], axis=0, out=upto[1:])
        shown, lo = np.array(names, object)[where].tolist(), 0
        for x, own in zip(texts, pieces, strict=True):
            hi = lo + len(own)
            if odd and own and not odd.isdisjoint(own):
                whole = self.groups(x)
                yield (*self._running(whole)[-1].tolist(), ";".join(self._names(whole))) if whole else _EMPTY
            else:
                yield *(upto[hi] - upto[lo]).tolist(), ";".join(shown[lo:hi])
            lo = hi

    def shapes(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, int, int]]:
        """Where groups end in the bytes of space and text, their ids, their links, tokens of A and B."""
        pieces = [self.pieces(x) if x else [] for x in texts]
        known = self.whole.known(set().union(*pieces))
        for x, own in zip(texts, pieces, strict=True):
            found = [known[p] for p in own]
            if None in found:
                whole = self.groups(x)
                found = [self._shape(whole, 0, len(whole.ends), self._names(whole))] if whole else []
            start, ends = 0, []
            for f in found:
                ends += [start + e for e in f[1]]
                start += f[0]
            yield ends, ";".join([f[2] for f in found]), np.frombuffer(b"".join([f[3] for f in found]), np.int64), sum(f[4] for f in found), sum(f[5] for f in found)


def tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


_OWN: dict = {}


def aligner(a_path: str, b_path: str, lookup=None, name: str = "") -> Aligner:
    """One for each worker process; another table of counts, by its name, replaces it."""
    key = (a_path, b_path, name)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Aligner(a_path, b_path, None if lookup is None else _unpack(lookup.value))
    return _OWN[key]


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.bool_, n, 16 * n)


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about four megabytes, with their texts."""
    raw, off = K.texts(batch.column(at))
    for lo, hi in K.parts(raw, off, 1 << 22):
        yield lo, hi, batch.column(at).slice(lo, hi - lo).to_pylist()


def _counted(a_path: str, b_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm import tokenalign

        own = tokenalign.aligner(a_path, b_path)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, texts in _runs(batch, 0):
                with tokenalign.without_cycles():
                    k, m = own.count(texts)
                keys, n = tally(np.concatenate((keys, k)), np.concatenate((n, m)))
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return run


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """key (A id << 32 | B id), n: how many links of the corpus hold each pair."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_counted(a_path, b_path), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """The table of `pair_counts` with `best` (no pair of the same B id has more); what is joined has a row for each id of B at most."""
    b = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def _reported(a_path: str, b_path: str, lookup, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm import tokenalign

        own = tokenalign.aligner(a_path, b_path, lookup, name)
        for batch in batches:
            for lo, hi, texts in _runs(batch, 1):
                with tokenalign.without_cycles():
                    a, b, g, best, n, names = zip(*own.report(texts), strict=True)
                sha = [x and hashlib.sha256(x.encode("ascii")).hexdigest() for x in names]
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (a, b, g, best, n)), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256"])

    return run


def _aligned(a_path: str, b_path: str, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm import tokenalign

        own = tokenalign.aligner(a_path, b_path)
        for batch in batches:
            for lo, hi, texts in _runs(batch, at):
                ends, names, links, a, b = zip(*own.shapes(texts), strict=True)
                part, longs = batch.slice(lo, hi - lo), pa.list_(pa.int64())
                columns = [pa.array(ends, longs), pa.array(names, pa.string()), pa.array([x.tolist() for x in links], longs), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "ends", "groups", "links", "n_a", "n_b"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ends` (where groups end in the bytes of space and text), `groups` (`a1,a2|b1;a3|b2`: their ids), `links` (A id << 32 | B id of each), `n_a` and `n_b`."""
    docs = docs.drop("ends", "groups", "links", "n_a", "n_b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_aligned(a_path, b_path, docs.columns.index(text_col)), f"{schema}, ends array<long>, groups string, links array<long>, n_a long, n_b long")


def report(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", lookup: int = LOOKUP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    scratch = Scratch(spark, "tokenalign")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = scratch.put(pair_counts(docs, a_path, b_path), "counts")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string"
    if counts.count() <= lookup:
        table = with_best(counts).toArrow()
        key, n, best = (table.column(c).to_numpy() for c in ("key", "n", "best"))
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast(b"".join((key[order].tobytes(), n[order].tobytes(), best[order].astype(np.bool_).tobytes())))
        out = docs.mapInArrow(_reported(a_path, b_path, sent, scratch.root), schema)
    else:
        out = _joined_counts(docs, with_best(counts), a_path, b_path, scratch)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def _joined_counts(docs: DataFrame, pairs: DataFrame, a_path: str, b_path: str, scratch: Scratch) -> DataFrame:
    """The same by a join: each row sends its different links once; a pair that is in very many rows is split as any skewed key of a join."""
    rows = align(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id())
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    rows = scratch.put(rows.select("_row", "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), sha.alias("groups_sha256"), "links"), "rows")
    links = rows.select("_row", F.explode("links").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("m"))
    best = F.sum(F.when(F.col("best"), F.col("m")).otherwise(0))
    sums = links.join(pairs, "key").groupBy("_row").agg(best.alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_best"), zero("count_sum"), "groups_sha256")
