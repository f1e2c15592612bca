"""Texts in parts that tokenizers treat alone, and bounded memories for such parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: A blank between two characters that are not blank: tokens never cross its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
SEGMENT_CHARS = 1 << 20
MEMORY_ENTRIES = 400_000


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The whole text in parts of about ``size`` characters, each but the first from a blank on."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Memory(dict):
    """Answers of ``make`` by part; forgets all when it holds ``entries``."""

    everyone: list[Memory] = []

    def __init__(self, make: Callable[[str], object], entries: int = MEMORY_ENTRIES) -> None:
        super().__init__()
        self.make, self.entries = make, entries
        self.everyone.append(self)

    def __missing__(self, part: str) -> object:
        if len(self) >= self.entries:
            self.clear()
        got = self[part] = self.make(part)
        return got


def only(*memories: Memory) -> None:
    """What other operators have learned in this worker process is forgotten."""
    for memory in Memory.everyone:
        if not any(memory is m for m in memories):
            memory.clear()
