"""Arrow-batched functions where no built-in exists: Unicode folding and sequence matching."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a comparison drops anywhere, and at both ends.
_ZERO = re.compile("[\u200b\u2060\u00ad\ufeff]")
_ENDS = " .,;:!?\"'()[]{}“”‘’·—–-"
_SPACE = re.compile(r"\s+")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def comparison_text(s: pd.Series) -> pd.Series:
    """NFKC, zero-width characters and soft hyphens dropped, white space collapsed, punctuation dropped at both ends, case folded."""

    def one(x: str | None) -> str:
        x = _ZERO.sub("", unicodedata.normalize("NFKC", x or ""))
        return _SPACE.sub(" ", x).strip().strip(_ENDS).casefold()

    return s.map(one)


def content_letters(x: str | None) -> str:
    """Letters and numbers of the NFKD form, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", x or "") if unicodedata.category(c)[0] in "LN" and not unicodedata.combining(c))


def seam(a: str, b: str, least: int) -> int:
    """Length of the longest end of `a` that begins `b`, 0 below `least`: linear in their lengths, by the prefix function of `b`."""
    n = min(len(a), len(b))
    if n < least:
        return 0
    tail = a[len(a) - n :]
    at = tail.find(b[:least])
    if at < 0:
        return 0
    tail, head = tail[at:], b[: n - at]
    border, k = [0] * len(head), 0
    for i in range(1, len(head)):
        while k and head[i] != head[k]:
            k = border[k - 1]
        k += head[i] == head[k]
        border[i] = k
    k = 0
    for ch in tail:
        if k == len(head):
            k = border[k - 1]
        while k and ch != head[k]:
            k = border[k - 1]
        k += ch == head[k]
    return k if k >= least else 0


@F.pandas_udf(T.IntegerType())
def overlap_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest suffix of `a`, of 12 characters at least, that is a prefix of `b`; else 0."""
    return pd.Series([seam(x or "", y or "", 12) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def repeated_seam(target: pd.Series, following: pd.Series, source: pd.Series, following_source: pd.Series) -> pd.Series:
    """Letters that a text repeats from the end of the one before, where their sources don't; else 0.

    Twelve letters at least, and either sixteen or 35 % of the shorter text. The sources repeat if they agree over that length, or over the shorter source.
    """

    def one(a: str | None, b: str | None, s: str | None, t: str | None) -> int:
        a, b = content_letters(a), content_letters(b)
        n = seam(a, b, 12)
        if not n or (n < 16 and n < 0.35 * min(len(a), len(b))):
            return 0
        s, t = content_letters(s), content_letters(t)
        k = min(n, len(s), len(t))
        return 0 if k >= 12 and s[-k:] == t[:k] else n

    return pd.Series([one(*r) for r in zip(target, following, source, following_source, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def token_coverage(part: pd.Series, whole: pd.Series) -> pd.Series:
    """1 for a substring, else the share of `part` in matching blocks."""

    def one(a: str | None, b: str | None) -> float:
        a, b = a or "", b or ""
        if not a:
            return 0.0
        if a in b:
            return 1.0
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        return sum(m.size for m in blocks) / len(a)

    return pd.Series([one(a, b) for a, b in zip(part, whole, strict=True)])


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """SequenceMatcher.find_longest_match of two whole strings, by a suffix automaton of `b`: linear in their lengths."""
    nxt: list[dict[str, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, ch in enumerate(b):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(i + 1)
        end.append(i)  # the first place where these substrings end
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best = (0, 0, 0)
    state = n = 0
    for i, ch in enumerate(a):
        while state and ch not in nxt[state]:
            state = link[state]
            n = length[state]
        if ch in nxt[state]:
            state, n = nxt[state][ch], n + 1
            if n > best[2]:
                best = (i - n + 1, end[state] - n + 1, n)
    return best


def alike(x: str, y: str, least: float) -> bool:
    """Whether SequenceMatcher's ratio (without junk) is `least` at least; it ends as soon as that is settled."""
    total = len(x) + len(y)
    m = SequenceMatcher(None, "", "", autojunk=False)
    bound = lambda a, b: (Counter(a) & Counter(b)).total()
    enough = lambda n: 2.0 * n / total >= least
    if not total:
        return True
    open_ = [(-bound(x, y), x, y)]
    matched, most = 0, -open_[0][0]
    while open_ and enough(most) and not enough(matched):
        n, a, b = heapq.heappop(open_)
        if len(a) * len(b) < 10_000:
            m.set_seqs(a, b)
            i, j, k = m.find_longest_match(0, len(a), 0, len(b))
        else:
            i, j, k = _longest(a, b)
        most += n
        if k:
            matched, most = matched + k, most + k
            for c, d in ((a[:i], b[:j]), (a[i + k :], b[j + k :])):
                if part := bound(c, d):
                    heapq.heappush(open_, (-part, c, d))
                    most += part
    return enough(matched)


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence, a bit for each character of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if u := v & where.get(ch, 0):
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _longest_by_size(a: str, b: str) -> tuple[int, int, int]:
    """As `_longest`: the greatest size of which both have a common piece, then its first place in each."""
    pieces = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    shared = lambda n: not pieces(b, n).isdisjoint(a[i : i + n] for i in range(len(a) - n + 1))
    most = min(len(a), len(b))
    lo, hi = 0, 1
    while hi <= most and shared(hi):
        lo, hi = hi, 2 * hi
    hi = min(hi, most + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if shared(mid) else (lo, mid)
    if not lo:
        return 0, 0, 0
    there = pieces(b, lo)
    i = next(i for i in range(len(a) - lo + 1) if a[i : i + lo] in there)
    return i, b.index(a[i : i + lo]), lo


def within(a: str, b: str, least: float) -> bool:
    """Whether the share of `a` in SequenceMatcher's matching blocks (without junk) is `least` at least; it ends as soon as that is settled.

    Blocks are a common subsequence, whose greatest length bounds what a pair of stretches can still match.
    """
    if not a:
        return least <= 0
    if a in b:
        return least <= 1
    enough = lambda n: n / len(a) >= least
    if not enough(min(len(a), len(b))):
        return False
    open_ = [(-_common(a, b), a, b)]
    matched, most = 0, -open_[0][0]
    while open_ and enough(most) and not enough(matched):
        n, x, y = heapq.heappop(open_)
        i, j, k = _longest_by_size(x, y) if max(len(x), len(y)) < 5_000 else _longest(x, y)
        most += n
        if k:
            matched, most = matched + k, most + k
            for c, d in ((x[:i], y[:j]), (x[i + k :], y[j + k :])):
                if part := _common(c, d):
                    heapq.heappush(open_, (-part, c, d))
                    most += part
    return enough(matched)


def covered(part: Column, whole: Column, least: float) -> Column:
    """Whether `token_coverage` is `least` at least, settled by bounds."""

    @F.pandas_udf(T.BooleanType())
    def one(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype=bool)

    return one(part, whole)


@F.pandas_udf(T.BooleanType())
def fuzzy_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """Both of 30 characters at least, length ratio 0.9 and matching ratio 0.96."""

    def one(x: str | None, y: str | None) -> bool:
        x, y = x or "", y or ""
        if min(len(x), len(y)) < 30 or min(len(x), len(y)) < 0.9 * max(len(x), len(y)):
            return False
        return x == y or alike(x, y, 0.96)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _union(boxes) -> float:
    """Area of the union: slabs between x edges, merged y intervals in each."""
    boxes = [b for b in boxes if b["x1"] > b["x0"] and b["y1"] > b["y0"]]
    edges = sorted({v for b in boxes for v in (b["x0"], b["x1"])})
    total = 0.0
    for lo, hi in zip(edges, edges[1:]):
        top = 0.0
        end = float("-inf")
        for y0, y1 in sorted((b["y0"], b["y1"]) for b in boxes if b["x0"] <= lo and b["x1"] >= hi):
            top += max(0.0, y1 - max(y0, end))
            end = max(end, y1)
        total += (hi - lo) * top
    return total


@F.pandas_udf(T.DoubleType())
def union_area(boxes: pd.Series) -> pd.Series:
    """Of an array of boxes."""
    return boxes.map(lambda x: 0.0 if x is None else _union(x))
