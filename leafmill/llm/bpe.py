"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merge table is compiled into a transducer over bytes. A text prefix has exactly one BPE encoding, and
that encoding without its last token is the encoding of the shorter prefix; so after each byte the machine
needs only the tokens that may end here or later, and the last token of each recent prefix. A thread is the trie node of the
bytes since a recent position. The set of all threads is a state of the determinised machine, named by its longest thread (the others are
suffixes of it); states, transitions and the tokens that end there are built when first met. The token that ends a prefix is the one
that may stand beside the last token of the prefix before it, which is decided by merging their bytes. Tokens are output as soon as the
encodings through all threads agree on them, at the end or after `LOOKAHEAD` more bytes.

Each match of the split pattern is encoded separately; results for white-space separated pieces are
memorised in a table of bounded size, which changes no result.

Defined results: null text encodes as the empty text; the empty text gives no ids; invalid UTF-8 cannot occur
in a string column, and `Utf8Stream` replaces it as Python's decoder does; rows with null or repeated ids are
encoded one by one and other columns pass through; an empty table gives an empty result; a text is held whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 150_000  # pieces remembered by a worker, of at most `PIECE` characters each
PIECE = 64
STATES = 200_000  # transitions, and decided pairs of tokens, kept by a worker
LOOKAHEAD = 1024
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank by token of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes one pre-token; `run` is deterministic and linear in the bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # by 256 * node + byte
        self.token_at, self.depth, self.above, self.byte = [-1], [0], [0], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.above.append(node)
                    self.byte.append(byte)
                node = nxt
            self.token_at[node] = rank
        self.deeper = bytearray(len(self.token_at))
        for key in self.child:
            self.deeper[key >> 8] = 1
        self.made: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.shorter: dict[int, int] = {}
        self.ending: dict[int, tuple[int, ...]] = {0: ()}
        self.beside: dict[int, bool] = {}

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """BPE of a short string by its definition: join the pair of least rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.made:
            parts = self.merged(self.tokens[token], 2)
            self.made[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.made[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b never joins across the border.

        Goes back in time along the right edge of a and the left edge of b, latest merge first. The two
        neighbours of each moment must have no merge that comes before the next one of either side; of equal
        ranks the left one comes first.
        """
        left, right, until, ranks, tokens = a, b, 1 << 60, self.ranks, self.tokens
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < until:
                ok = False
                break
            l, r = self.halves(left), self.halves(right)
            if l and (not r or left > right):
                until, left = left, l[1]
            elif r:
                until, right = right + 1, r[0]
            else:
                ok = True
                break
        self.beside[a << 32 | b] = ok
        return ok

    def next_shorter(self, node: int) -> int:
        """The longest thread that is a proper suffix of this one."""
        if self.depth[node] < 2:
            return 0
        found = self.shorter.get(node)
        if found is None:
            found = self.shorter[node] = self.step(self.next_shorter(self.above[node]), self.byte[node])
        return found

    def step(self, node: int, byte: int) -> int:
        while True:
            nxt = self.child.get(node << 8 | byte)
            if nxt is not None:
                return nxt
            if not node:
                return 0
            node = self.next_shorter(node)

    def endings(self, node: int) -> tuple[int, ...]:
        """Tokens that end with this state, the longest first."""
        found = self.ending.get(node)
        if found is None:
            token = self.token_at[node]
            found = self.ending[node] = (*((token,) if token >= 0 else ()), *self.endings(self.next_shorter(node)))
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that end there."""
        nxt = self.step(state, byte)
        move = self.moves[state << 8 | byte] = nxt, self.endings(nxt)
        return move

    def back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the encoding that ends at a position; ends: the last token at each."""
        out, size = [], self.size
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def agreed(self, state: int, ends: list[int]) -> int:
        """The last position through which the encodings of all threads go."""
        at = {len(ends)}
        while state:
            if self.deeper[state]:
                at.add(len(ends) - self.depth[state])
            state = self.next_shorter(state)
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.size[ends[last - 1]])
        return at.pop()

    def run(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.moves) > STATES or len(self.beside) > STATES:
            self.reset()
        state, moves, size, beside, out, ends, at, prior = 0, self.moves, self.size, self.beside, [], [], 0, -1
        for lo in range(0, len(data), LOOKAHEAD):
            for byte in data[lo : lo + LOOKAHEAD]:
                state, tokens = moves.get(state << 8 | byte) or self.move(state, byte)
                at += 1
                for token in tokens:
                    before = at - size[token]
                    last = ends[before - 1] if before else prior
                    if last < 0:
                        break
                    ok = beside.get(last << 32 | token)
                    if ok is None:
                        ok = self.may_follow(last, token)
                    if ok:
                        break
                ends.append(token)
            cut = at if lo + LOOKAHEAD >= len(data) else self.agreed(state, ends)
            out += self.back(ends, cut)
            if cut:
                prior = ends[cut - 1]
                del ends[:cut]
                at -= cut
        return out


class _Memo(dict):
    """Ids as little-endian bytes by piece; None if the piece needs the text around it."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, piece: str) -> bytes | None:
        out = self.old.get(piece)
        if out is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            out = self.encode(self.lead + piece)
        if len(piece) <= PIECE:
            self[piece] = out
        return out

    def age(self) -> None:
        """Forgets what was not used since the last call."""
        self.old = dict(self)
        self.clear()


class Codec:
    """Encoder and decoder of one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.fst = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.first, self.later = _Memo(self._spans, ""), _Memo(self._spans, " ")
        self.newline = self._spans("\n") if b"\n" in ranks else None

    def _span(self, span: str) -> bytes:
        ids = self.fst.run(span.encode("utf-8"))
        return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _spans(self, text: str) -> bytes:
        found = self.find(text)
        return self._span(found[0]) if len(found) == 1 else b"".join(map(self._known, found))

    def _known(self, span: str) -> bytes:
        ids = self.later[span[1:]] if span[0] == " " else self.first[span]
        return self._span(span) if ids is None else ids

    def encode(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit little-endian integers.

        Where a single space or newline stands between two other characters, a match of the split pattern
        begins at it, so pieces can be encoded apart; a text with any other white space goes whole.
        """
        if not text:
            return b""
        if len(self.first) + len(self.later) > MEMO:
            self.first.age()
            self.later.age()
        out, first, later = [], self.first, self.later.__getitem__
        try:
            for line in text.split("\n"):
                pieces = line.split(" ")
                out.append(first[pieces[0]])
                if len(pieces) > 1:
                    out[-1] += b"".join(map(later, pieces[1:]))
            return self.newline.join(out)
        except TypeError:  # a piece without ids of its own
            return self._spans(text)

    def decode(self, ids: bytes, chunk: int = 1 << 16) -> Iterator[str]:
        """Text of encoded ids, piece by piece."""
        stream, tokens = Utf8Stream(), self.fst.tokens
        for lo in range(0, len(ids), 4 * chunk):
            part = memoryview(ids)[lo : lo + 4 * chunk].cast("I")
            yield stream.feed(b"".join(map(tokens.__getitem__, part)))
        yield stream.end()


class Utf8Stream:
    """Incremental UTF-8: its state is the unfinished sequence, at most three bytes."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that more bytes can complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        if self.held:
            data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :] if keep else b""
        return (data[: len(data) - keep] if keep else data).decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def _encoded(path: str, pattern: str, text_at: int, decode: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm import bpe

        own = bpe.codec(path, pattern)
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = [own.encode(x) for x in part.column(text_at).to_pylist()]
                columns = [*part.columns, pa.array(ids, pa.binary())]
                names = [*part.schema.names, "ids"]
                if decode:
                    columns.append(pa.array(["".join(own.decode(x)) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """`df` with `ids` (binary, unsigned 32-bit little-endian) and, on request, `decoded` text.

    path: a .tiktoken rank file that every executor has. Columns named `ids` or `decoded` are replaced.
    """
    df = df.drop("ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema += ", ids binary" + (", decoded string" if decode else "")
    return df.mapInArrow(_encoded(path, pattern, df.columns.index(text_col), decode), schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    return df.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
