"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class,
represented by the least id. All sets are ordered by one global order, rarest first: the counts of the `HEAVY`
most frequent shingles, gathered over all documents in chunks and so a little low for less frequent ones, then the hash. Any global
order gives the same result; a good one keeps frequent shingles out of the prefixes. Two sets that reach the threshold share at least L shingles of their
prefixes of length n - ceil(threshold * n) + L, for any L; each document picks the L of least estimated cost
(postings read, and candidates that remain when L matches are needed), and a pair needs as many
shared prefix shingles as the smaller L of the two before its sets are compared. Most prefix shingles are held by one class only; a
bitmap of those that come twice drops them within tasks, before anything is shuffled (it may let some through).

Pairs are not all made: first every posting list compares its members with one leader, the one with least before it, which joins
a group of copies in as many comparisons as it has members; then only lists that still hold several components
are joined with themselves, and only across components. That second step is exact for all that remains, so the
components are those of all links.

Defined results: null or empty text, or one without words, has an empty set and no link; a text of fewer words than
a shingle is one shingle; rows with null id have a null component; rows that repeat an id link through
either text; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import textkernel as K
from leafmill.llm.components import components
from leafmill.llm.idfilter import packed, slots, thin, twice_bits
from leafmill.llm.scratch import Scratch

_U = np.uint64
CHUNK = 1 << 21  # shingles counted together; those seen once in a chunk are not frequent there
HEAVY = 1 << 19
MOST_MATCHES = 3
STARS = 1
COMPARE_COST = 20.0  # of comparing two sets, in postings read
BITS = 26  # of the bitmap of prefix shingles that two classes hold
FLUSH = 1 << 20  # shingles that a task packs together


def need(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any partner: ceil(percent / 100 * n)."""
    return (percent * n + 99) // 100


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted shingle hashes of each text."""
    raw, off = K.texts(batch.column(column))
    for lo, hi in K.parts(raw, off):
        _, _, h, at = K.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
        for i in range(hi - lo):
            yield lo + i, K.shingle_set(h[at[i] : at[i + 1]], k)


def _repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one set of the chunk holds, and in how many."""
    s = np.concatenate(parts)
    s.sort()
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    n = np.diff(edge)
    many = n > 1
    return s[edge[:-1][many]], n[many]


def _survey(k: int):
    """Rows of kind 0: id, set size and a 128-bit digest of the set. Rows of kind 1: a shingle that repeats in a chunk, and its count."""
    names = ["kind", "id", "n", "a", "b"]

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, n = _repeated(parts)
        zero = np.zeros(len(token), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(token.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(zero), pa.array(zero)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows, n, a, b = [], [], [], []
            for row, s in _sets(batch, 1, k):
                rows.append(row)
                n.append(len(s))
                a.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                b.append(int(K.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield counted(held)
                    held, size = [], 0
            if rows:
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch.column(0), pa.array(n, pa.int64()), signed(a), signed(b)], names)
        if size:
            yield counted(held)

    return run


def frequency(heavy: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """Counts of the shingles among the heavy ones (sorted), 1 for all others."""
    token, n = heavy
    if not len(token):
        return np.ones(len(s), np.int64)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, n[at], 1)


def choose(freq: np.ndarray, n: int, percent: int, most: int = MOST_MATCHES) -> int:
    """The number of matches L of least cost for a set whose ordered shingles have estimated frequencies `freq`."""
    first = n - need(n, percent) + 1
    best, at = float("inf"), 1
    upto = np.cumsum(freq[: first + most - 1].astype(np.float64))
    for matches in range(1, most + 1):
        length = first + matches - 1
        if length > n or matches > need(n, percent):
            break
        cost = upto[length - 1] * (1 + COMPARE_COST / matches**2)
        if cost < best:
            best, at = cost, matches
    return at


def _marked(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & _U(1) == 1


def _prefixes(k: int, percent: int, heavy, reps):
    """Rows (id, text, slot of id) whose slot is set to prefixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tuple(np.frombuffer(x, t) for x, t in zip(heavy.value, (np.uint64, np.int64), strict=True))
        wanted = np.frombuffer(reps.value, np.uint64)
        for batch in batches:
            batch = batch.filter(pa.array(_marked(wanted, batch.column(2).to_numpy())))
            ids = batch.column(0).to_pylist()
            rep, n, matches, tokens = [], [], [], []
            for row, s in _sets(batch, 1, k):
                if not len(s) or ids[row] is None:
                    continue
                freq = frequency(pair, s)
                order = np.lexsort((s, freq))
                m = choose(freq[order], len(s), percent)
                rep.append(ids[row])
                n.append(len(s))
                matches.append(m)
                tokens.append(s[order[: len(s) - need(len(s), percent) + m]].view(np.int64))
            if rep:
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(matches, pa.int32()), lists], ["rep", "n", "matches", "tokens"])

    return run


def _slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top BITS + 16 bits of all prefix shingles (one list column), packed."""

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        return packed(np.sort(np.concatenate(held)) >> _U(48 - BITS), 32)

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
        size += len(held[-1])
        if size >= FLUSH:
            yield made(held)
            held, size = [], 0
    if size:
        yield made(held)


def _repeating(bitmap):
    """Rows (rep, n, matches, tokens) to those of their tokens whose bit is set, with their positions in the prefix; rows without any go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            token, size = batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy()
            slot = (token.view(np.uint64) >> _U(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(_marked(words, slot))
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)[at]
            rows, begin = np.unique(row, return_index=True)
            if len(rows):
                off = pa.array(np.concatenate((begin, [len(at)])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (token[at], (at - first[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).take(pa.array(rows)).columns, *lists], ["rep", "n", "matches", "tokens", "at"])

    return run


def _linked(percent: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                others = [s for _, s in _sets(part, 3, k)]
                keep = np.zeros(part.num_rows, bool)
                for i, text in enumerate(part.column(2).to_pylist()):
                    if text != last[0]:  # rows come sorted by u
                        last = text, next(s for _, s in _sets(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["t"]), 0, k))
                    x, y = last[1], others[i]
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["u", "v"])

    return run


class JaccardJoin:
    """One join over (doc_id, text) rows."""

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark, self.k, self.percent = spark, k, percent
        self.scratch = Scratch(spark, "jaccardjoin")
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self._survey()

    def _survey(self) -> None:
        seen = self.scratch.put(self.docs.mapInArrow(_survey(self.k), "kind int, id long, n long, a long, b long"), "survey")
        self.info = seen.where("kind = 0").select("id", "n", "a", "b")
        counts = seen.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
        token, n = (top.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
        token = token.view(np.uint64)
        order = np.argsort(token)
        self.heavy = self.spark.sparkContext.broadcast((token[order].tobytes(), n[order].tobytes()))
        classes = self.info.where("n > 0 and id is not null").groupBy("n", "a", "b").agg(F.min("id").alias("rep"))
        self.classes = self.scratch.put(classes, "classes")

    def _postings(self) -> DataFrame:
        """(token, rep, n, matches) of prefix shingles that more than one class holds."""
        slot, reps = slots(self.spark, self.classes.select("rep"))
        docs = self.docs.where("id is not null").select("id", "text", slot(F.col("id")).alias("slot"))
        every = self.scratch.put(docs.mapInArrow(_prefixes(self.k, self.percent, self.heavy, reps), "rep long, n long, matches int, tokens array<long>"), "every-prefix")
        twice = twice_bits(self.spark, every.select("tokens").mapInArrow(_slots, "part long, slots binary"), BITS)
        lists = every.mapInArrow(_repeating(twice), "rep long, n long, matches int, tokens array<long>, at array<int>")
        lists = lists.join(self.classes.select("rep", "n"), ["rep", "n"], "left_semi")
        if self._repeats():
            lists = lists.dropDuplicates(["rep", "n", "matches", "tokens", "at"])
        lists = self.scratch.put(lists, "prefixes")
        self.scratch.drop(every)
        rows = lists.select("rep", F.explode(F.arrays_zip("at", "tokens")).alias("p")).select("rep", F.col("p.at").alias("pos"), F.col("p.tokens").alias("token"))
        if self._repeats():
            rows = rows.groupBy("rep", "token").agg(F.lit(0).alias("pos"))
        shared = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        tokens = F.array_distinct(F.flatten(F.collect_list("tokens")))
        self.sets = lists.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("least_n"), F.min("matches").alias("matches"), tokens.alias("tokens"))
        return self.scratch.put(rows.join(shared, "token").join(self.sets.drop("tokens"), "rep"), "postings")

    def _repeats(self) -> bool:
        """Whether some id has several rows."""
        row = self.info.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).agg(F.max("c")).first()
        return (row[0] or 0) > 1

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that reach the threshold."""
        pairs = self.scratch.put(pairs, "pairs")
        wanted = pairs.select("u").union(pairs.select("v")).distinct()
        texts = self.scratch.put(thin(self.spark, self.docs.where("id is not null and text is not null"), "id", wanted), "texts")
        a = texts.select(F.col("id").alias("u"), F.col("text").alias("x"))
        b = texts.select(F.col("id").alias("v"), F.col("text").alias("y"))
        rows = pairs.join(b, "v").join(a, "u").select("u", "v", "x", "y")
        out = self.scratch.put(rows.mapInArrow(_linked(self.percent, self.k), "u long, v long"), "links")
        self.scratch.drop(texts, pairs)
        return out

    def _possible(self) -> F.Column:
        """Whether two postings of one shingle can belong to a link, by sizes and positions.

        If it is the first shingle that the two prefixes share, nothing before it is common, so the sets overlap in no more than what
        either has from there on. A link passes at the first shingle it shares, which is all it needs.
        """
        p = self.percent
        sizes = (F.greatest("a.least_n", "b.least_n") <= F.least("a.n", "b.n")) | (100 * F.least("a.n", "b.n") >= p * F.greatest("a.least_n", "b.least_n"))
        most = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        return sizes & ((100 + p) * most >= p * (F.col("a.least_n") + F.col("b.least_n")))

    def _matched(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose prefixes share as many shingles as the smaller number of matches of the two."""
        side = lambda n: self.sets.select(F.col("rep").alias(n), F.col("matches").alias(f"m_{n}"), F.col("tokens").alias(f"t_{n}"))
        both = pairs.join(side("v"), "v").join(side("u"), "u")
        return both.where(F.size(F.array_intersect("t_u", "t_v")) >= F.least("m_u", "m_v")).select("u", "v")

    def _stars(self, postings: DataFrame, priority: F.Column) -> DataFrame:
        """Pairs of every posting with its shingle's first member by `priority`, with as many matches as they need."""
        leaders = postings.groupBy("token").agg(F.min_by(F.struct("rep", "n", "least_n", "pos", "root"), priority).alias("b"))
        pairs = postings.alias("a").join(leaders.select("token", "b.*").alias("b"), "token").where(F.col("a.root") != F.col("b.root")).where(self._possible())
        return self._matched(pairs.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct())

    def _mixed(self, live: DataFrame, roots: DataFrame) -> DataFrame:
        """Postings of the shingles that still hold several components."""
        rooted = live.drop("root").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        return self.scratch.put(rooted.join(mixed, "token"), "rest")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links between classes that give the components of all links, and the components (node, root)."""
        rest = self._postings().withColumn("root", F.col("rep"))
        every = None
        for turn in range(STARS):
            order = F.struct("pos", F.xxhash64("rep").alias("h")) if turn == 0 else F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"))
            found = self._verify(self._stars(rest, order))
            every = found if every is None else every.unionByName(found)
            roots = self.scratch.put(components(every, self.scratch), "roots")
            rest = self._mixed(rest, roots)
        across = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & self._possible()
        pairs = rest.alias("a").join(rest.alias("b"), across)
        pairs = self._matched(pairs.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct())
        every = self.scratch.put(every.unionByName(self._verify(pairs)), "all-links")
        return every, self.scratch.put(components(every, self.scratch), "components")

    def result(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        _, roots = self.links()
        named = self.classes.join(roots, F.col("rep") == F.col("node"), "left").select("n", "a", "b", F.coalesce("root", "rep").alias("component"))
        out = self.info.join(named, ["n", "a", "b"], "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
        if self._repeats():  # rows of one id are one node
            least = out.groupBy("id").agg(F.min(component).alias("least"), F.collect_set("component").alias("all"))
            merged = components(least.select(F.explode("all").alias("u"), F.col("least").alias("v")), self.scratch)
            out = out.join(merged, component == F.col("node"), "left")
            component = F.coalesce("root", component)
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def join(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    return JaccardJoin(spark, docs, k, percent).result()


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s0 AS (SELECT doc_id, list_distinct(CASE WHEN len(x) = 0 THEN []::VARCHAR[] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
  ELSE list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) END) AS s FROM w),
s AS (SELECT doc_id, list_sort(s) AS s, len(s)::BIGINT AS n FROM s0),
g AS (SELECT s, n, min(doc_id) AS rep FROM s WHERE n > 0 GROUP BY s, n),
t AS (SELECT rep, n, unnest(s) AS tok FROM g),
f AS (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1),
t2 AS (SELECT t.* FROM t JOIN f USING (tok)),
p AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c, any_value(a.n + b.n) AS nn FROM t2 a JOIN t2 b ON a.tok = b.tok AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT u, v FROM p WHERE 100 * c >= 90 * (nn - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT rep AS node, rep AS root FROM g UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN g ON s.s = g.s AND s.n > 0 LEFT JOIN m ON g.rep = m.node
"""
