"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; in each, one gated recurrent layer reads forwards and one backwards, and a
softmax over both states labels every byte with a language. A document's probabilities are the mean over
all its bytes. The network is trained with numpy by backpropagation through time (Adam) on a sample of at
most `SAMPLE` documents of each language (`SAMPLE_CHARS` characters of each), those with the least hashes of their ids among the rows that may be learned from.

Gates use x / (1 + |x|), moved to (0, 1), instead of exponentials: a byte costs a few additions, and the same function is
used in training.

Defined results: null text or one without a letter is `und` with score 0; with no learnable row every text is `und`
with score 0; rows with null or repeated ids are labelled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import textkernel as K

SAMPLE = 150  # documents of a language
SAMPLE_CHARS = 1 << 16  # of each of them that the network learns from; every text is labelled as a whole
WINDOW = 64
HIDDEN = 8
STEPS = 220
BATCH = 192
RATE = 0.02
UNKNOWN = "und"
_F = np.float32


def _gate(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Parameters by name; forward and backward layers have suffix 0 and 1."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.h, self.c = hidden, classes
        self.p: dict[str, np.ndarray] = {"bias": np.zeros((classes, 1), _F)}
        for side in "01":
            self.p["in" + side] = rng.normal(0, 0.5, (3 * hidden, 256)).astype(_F)
            self.p["rec" + side] = rng.normal(0, 0.5 / hidden**0.5, (3 * hidden, hidden)).astype(_F)
            self.p["out" + side] = rng.normal(0, 0.5 / hidden**0.5, (classes, hidden)).astype(_F)

    def _layer(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, rows) of bytes x (steps, rows), in the order given."""
        n, p = self.h, self.p
        table, rec = p["in" + side], p["rec" + side]
        steps, rows = x.shape
        states = np.empty((steps, n, rows), _F)
        h = np.zeros((n, rows), _F)
        fed, g = np.empty((3 * n, rows), _F), np.empty((3 * n, rows), _F)
        for t in range(steps):
            np.take(table, x[t], axis=1, out=fed, mode="clip")
            np.matmul(rec, h, out=g)
            zr = fed[: 2 * n]
            zr += g[: 2 * n]
            zr /= 1 + np.abs(zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:n], zr[n:]
            a = r * g[2 * n :]
            a += fed[2 * n :]
            c = a / (1 + np.abs(a))
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), g[2 * n :].copy(), c))
            h = np.subtract(h, c, out=states[t])
            h *= z
            h += c
        return states

    def logits(self, x: np.ndarray, tape: tuple | None = None) -> np.ndarray:
        """(steps, classes, rows) for bytes x (steps, rows)."""
        ahead = self._layer(x, "0", tape[0] if tape else None)
        back = self._layer(x[::-1], "1", tape[1] if tape else None)[::-1]
        return np.matmul(self.p["out0"], ahead) + np.matmul(self.p["out1"], back) + self.p["bias"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        y = self.logits(x)
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over unmasked positions, by backpropagation through time."""
        tape: tuple[list, list] = ([], [])
        y = self.logits(x, tape)
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        rows = np.arange(x.shape[1])
        y[:, label, rows] -= 1
        y *= (mask / max(1.0, float(mask.sum())))[:, None, :]
        grad = {"bias": y.sum((0, 2))[:, None]}
        for side, dy, bytes_ in (("0", y, x), ("1", y[::-1], x[::-1])):
            grad |= self._layer_gradients(side, dy, bytes_, tape[int(side)])
        return grad

    def _layer_gradients(self, side: str, dy: np.ndarray, x: np.ndarray, tape: list) -> dict[str, np.ndarray]:
        n, p = self.h, self.p
        rec, out = p["rec" + side], p["out" + side]
        d_table, d_rec, d_out = np.zeros((256, 3 * n), _F), np.zeros_like(rec), np.zeros_like(out)
        dh = np.zeros((n, x.shape[1]), _F)
        d_in = np.empty((3 * n, x.shape[1]), _F)
        d_g = np.empty_like(d_in)
        for t in range(len(tape) - 1, -1, -1):
            before, z, r, gc, c = tape[t]
            h = c + z * (before - c)
            d_out += dy[t] @ h.T
            dh = dh + out.T @ dy[t]
            dc = dh * (1 - z)
            da = dc * (1 - np.abs(c)) ** 2
            dz = dh * (before - c)
            dr = da * gc
            # for s = (1 + u) / 2, u = x / (1 + |x|): ds/dx = (1 - |u|)^2 / 2
            d_in[:n] = dz * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_in[n : 2 * n] = dr * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_in[2 * n :] = da
            d_g[: 2 * n] = d_in[: 2 * n]
            d_g[2 * n :] = da * r
            d_rec += d_g @ before.T
            np.add.at(d_table, x[t], d_in.T)
            dh = dh * z + rec.T @ d_g
        return {"in" + side: d_table.T, "rec" + side: d_rec, "out" + side: d_out}


def cuts(off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and size of every window of all texts."""
    n = np.diff(off)
    count = -(-n // window)
    text = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    start = off[text] + (np.arange(len(text)) - first[text]) * window
    return start, text, np.minimum(window, off[text + 1] - start)


def filled(raw: np.ndarray, start: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(window, rows) bytes; zero beyond a window's size."""
    if not len(start):
        return np.zeros((window, 0), np.uint8)
    at = start[None, :] + np.arange(window)[:, None]
    out = raw[np.minimum(at, len(raw) - 1, out=at)]
    short = np.flatnonzero(size < window)
    out[:, short] *= (np.arange(window)[:, None] < size[short]).astype(np.uint8)
    return out


def cut(raw: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as (window, rows) bytes, the text of each and the bytes it holds."""
    start, text, size = cuts(off, window)
    return filled(raw, start, size, window), text, size


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7) -> tuple[Network, list[str]]:
    langs = sorted(set(labels))
    net, rng = Network(len(langs), seed=seed), np.random.default_rng(seed)
    raw, off = K.texts(pa.array(texts, pa.string()))
    x, text, size = cut(raw, off)
    y = np.array([langs.index(v) for v in labels])[text]
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(r, max(1, BATCH // len(of))) for r in of])
        mask = (np.arange(WINDOW)[:, None] < size[rows]).astype(_F)
        mask[: WINDOW // 8] *= 0.5  # the first and last bytes see little
        grad = net.gradients(x[:, rows], y[rows], mask)
        norm = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
        rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(_F)
    return net, langs


def label(net: Network, langs: list[str], array: pa.Array, rows: int = 2048) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of an Arrow array."""
    raw, off = K.texts(array)
    total = np.zeros((len(array), len(langs)))
    for lo, hi in K.parts(raw, off, 1 << 22):
        start, text, size = cuts(off[lo : hi + 1])
        for k in range(0, len(start), rows):
            own = slice(k, k + rows)
            p = net.probabilities(filled(raw, start[own], size[own]))
            if (short := size[own] < WINDOW).any():
                p[:, :, short] *= (np.arange(WINDOW)[:, None] < size[own][short])[:, None, :]
            np.add.at(total, lo + text[own], p.sum(0).T)
    total /= np.maximum(1, np.diff(off))[:, None]
    best = total.argmax(1)
    letters = np.array([v.is_valid and any(map(str.isalpha, v.as_py())) for v in array], bool)
    score = np.where(letters, total[np.arange(len(best)), best], 0.0).clip(0, 1)
    return [langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], score


def _labelled(net: Network | None, langs: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if net is None:
                    langs_, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    langs_, score = label(net, langs, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs_, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return run


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, mod 3, is 1; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[Network | None, list[str]]:
    """A network trained on at most `sample` documents of each language that are not held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~held_out(id_col))
    langs = [r[0] for r in docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(lang_col).distinct().collect()]
    texts, labels = [], []
    for lang in sorted(langs):
        ids = rows.where(F.col(lang_col) == lang).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        chosen = [r[0] for r in ids.collect()]
        for r in rows.where(F.col(id_col).isin(chosen) & (F.col(lang_col) == lang)).select(id_col, F.substring(text_col, 1, SAMPLE_CHARS).alias(text_col)).orderBy(id_col, text_col).limit(sample).collect():
            texts.append(r[1])
            labels.append(lang)
    return train(texts, labels) if texts else (None, [])


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` with `lang_pred` and `score`; columns of these names are replaced."""
    net, langs = fit(docs, id_col, text_col, lang_col)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(_labelled(net, langs, docs.columns.index(text_col)), schema)


def predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = identify(spark, docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
