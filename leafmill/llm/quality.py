"""Quality rules as a short-circuit cascade.

Base columns are computed for every text. A text that passes the base rule then goes through further rules;
each is evaluated only on texts that no earlier rule has rejected. Cost and selectivity of each
rule are measured on a sample of at most `SAMPLE` documents (least hashes of the id), and rules run by rejections per
second, best first. The verdict is the conjunction of all rules, so the order changes the time, never the result.

Defined results: null or empty text has no words and fails the base rule; rows with null or repeated ids
are judged one by one; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textkernel as K

SAMPLE = 512
SAMPLE_CHARS = 1 << 16  # of each sampled text, to time the rules on
WINDOW = 5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
# lead bytes of letters beyond ASCII: Latin to Arabic scripts, other scripts up to 0xED but not 0xE2 (signs, arrows, dashes); 0xF0 (emoji) is none
_LETTER[0xC3:0xEE] = True
_LETTER[0xE2] = False
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


class Part:
    """Some texts and what all rules may share."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.raw, self.off = raw, off
        _, _, self.hashes, self.at = K.words(raw, off)
        self.n_words = np.diff(self.at)

    def count(self, table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """How many bytes of each text are in `table`; of some texts only, if rows are given."""
        if rows is None or 2 * len(rows) > len(self.off):
            total = np.zeros(len(self.raw) + 1, np.int64)
            np.cumsum(table[self.raw], out=total[1:])
            got = total[self.off[1:]] - total[self.off[:-1]]
            return got if rows is None else got[rows]
        return np.array([np.count_nonzero(table[self.raw[self.off[i] : self.off[i + 1]]]) for i in rows], np.int64)

    def base(self) -> dict[str, np.ndarray]:
        n = len(self.n_words)
        repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            h = self.hashes[self.at[i] : self.at[i + 1]]
            if len(h) > WINDOW:
                w = K.windows(h, WINDOW)
                order = np.argsort(w, kind="stable")
                same = w[order][1:] == w[order][:-1]
                if same.any():
                    twice = np.zeros(len(w), bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    edge = np.zeros(len(h) + 1, np.int64)
                    at = np.flatnonzero(twice)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    repeat[i] = np.count_nonzero(np.cumsum(edge) > 0)
            lines = self.raw[self.off[i] : self.off[i + 1]].tobytes().split(b"\n")
            if len(lines) > 1:
                real = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
                dup[i] = len(real) - len(set(real))
        bad = (self.n_words < 10) | (100 * repeat > 20 * self.n_words)
        return {
            "n_words": self.n_words,
            "word_chars": self.count(~(_TAIL | K.WS)),
            "n_symbols": self.count(_SYMBOL),
            "n_dup_lines": dup,
            "n_repeat_words": repeat,
            "base_failed": bad,
        }


def _symbols(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    return base["n_symbols"][rows] > 0.1 * p.n_words[rows]


def _word_length(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    mean = base["word_chars"][rows] / np.maximum(1, p.n_words[rows])
    return (mean < 2) | (mean > 15)


def _dup_lines(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    lines = np.array([np.count_nonzero(p.raw[p.off[i] : p.off[i + 1]] == 10) + 1 for i in rows])
    return base["n_dup_lines"][rows] > 0.3 * lines


def _shouting(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    return 2 * p.count(_UPPER, rows) > np.maximum(1, p.count(_LETTER, rows))


def _exclaiming(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    return p.count(_LOUD, rows) > 0.3 * p.n_words[rows]


def _letters(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    return 2 * p.count(_LETTER, rows) < base["word_chars"][rows]


def _stutter(p: Part, base: dict, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, i in enumerate(rows):
        h = p.hashes[p.at[i] : p.at[i + 1]]
        out[k] = np.count_nonzero(h[1:] == h[:-1]) > 0.2 * len(h)
    return out


#: Every rule: the texts among `rows` that it rejects.
RULES = {
    "symbols": _symbols,
    "word_length": _word_length,
    "dup_lines": _dup_lines,
    "shouting": _shouting,
    "exclaiming": _exclaiming,
    "letters": _letters,
    "stutter": _stutter,
}


def plan(texts: list[str | None]) -> list[str]:
    """Rule names by rejections per second on a sample."""
    raw, off = K.texts(pa.array(texts, pa.string()))
    part = Part(raw, off)
    base = part.base()
    rows = np.flatnonzero(~base["base_failed"])
    rate = {}
    for name, rule in RULES.items():
        t = time.perf_counter()
        hits = int(np.count_nonzero(rule(part, base, rows))) if len(rows) else 0
        rate[name] = (hits + 0.5) / (time.perf_counter() - t + 1e-6)
    return sorted(RULES, key=lambda name: -rate[name])


def judge(part: Part, order: list[str]) -> dict[str, np.ndarray]:
    base = part.base()
    rows = np.flatnonzero(~base["base_failed"])
    for name in order:
        if not len(rows):
            break
        rows = rows[~RULES[name](part, base, rows)]
    kept = np.zeros(len(part.n_words), bool)
    kept[rows] = True
    return base | {"kept": kept}


def _judged(order: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.texts(batch.column(1))
            for lo, hi in K.parts(raw, off):
                part = Part(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                out = judge(part, order)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in out.values())], ["doc_id", *out])

    return run


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """A row for each document: its base columns and verdict."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    some = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy("doc_id", "text").limit(sample)
    return docs.mapInArrow(_judged(plan([r.text for r in some.collect()])), SCHEMA)


ORACLE = None
