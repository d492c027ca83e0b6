"""Cutting texts where no tokenizer piece can reach across, and a bounded cache of what a segment gives."""

from __future__ import annotations

import re
from collections.abc import Callable

#: In byte-level BPE a space before a visible character starts a piece, whatever stands before it.
_BEFORE_VISIBLE = re.compile(r" (?=\S)")
#: In sentencepiece BPE runs of spaces can be pieces: only a lone space is sure to start one.
_LONE = re.compile(r"(?<=[^ ]) (?! )")


def segments(text: str, lone: bool = False) -> list[str]:
    """The text's segments; each but the first stands for a space and itself."""
    return (_LONE if lone else _BEFORE_VISIBLE).split(text)


class Cache(dict):
    """make(segment), computed once for each segment; emptied when its segments reach `most` characters."""

    def __init__(self, make: Callable[[str], object], most: int = 40_000_000) -> None:
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, segment: str) -> object:
        value = self.make(segment)
        if len(segment) <= 64:
            self.held += len(segment) + 40
            if self.held > self.most:
                self.clear()
                self.held = len(segment)
            self[segment] = value
        return value
