"""What is known about pieces of text, of bounded size: pieces that were not used for a while are forgotten and learned again."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterable, Iterator

MEMO = 200_000
#: Pieces learned at once.
STEP = 20_000


class Memo:
    """learn: values of a list of pieces that are not known yet, in their order."""

    def __init__(self, learn: Callable[[list[str]], Iterable], size: int = MEMO) -> None:
        self.learn, self.size = learn, size
        self.new: dict = {}
        self.old: dict = {}

    def known(self, wanted: set[str]) -> dict:
        """A table that has all of `wanted`; good until the next call."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        fresh = []
        for piece in wanted.difference(self.new):
            if piece in self.old:
                self.new[piece] = self.old[piece]
            else:
                fresh.append(piece)
        for lo in range(0, len(fresh), STEP):
            some = fresh[lo : lo + STEP]
            self.new.update(zip(some, self.learn(some), strict=True))
        return self.new


@contextlib.contextmanager
def without_cycles() -> Iterator[None]:
    """Without the search for reference cycles: it would walk through all that is remembered, and no cycles are made here."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
