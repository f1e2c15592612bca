"""Byte-level BPE by a finite-state transducer that is determinised while it runs.

A state is what the bytes read so far leave open: every place where a token may still be under
way (its node in the trie of tokens), and the tokens that lead to that place and are not yet
certain. For each prefix of a text there is exactly one token with which its encoding ends: the
one that fits behind the last token of the place where it starts. Two tokens fit when merging
their bytes by rank gives these two again. A transition extends all open places by one byte,
emits the tokens on which all of them agree, and is remembered from the second time on. As no token is longer than the
longest word of the vocabulary, the lookahead is bounded.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fleetwitness.llm.spans import Memory, only, segments

MOST_STATES = 150_000
NOTHING: tuple[int, ...] = ()
#: Stands for a transition that was taken once; it is made when it is taken again.
AGAIN: tuple = ()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: the adjacent pair with the lowest rank, the leftmost of equals, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State:
    """Open places, earliest first: (trie node, tokens since the last certain one)."""

    __slots__ = ("certain", "next", "places")

    def __init__(self, certain: int, places: tuple) -> None:
        self.certain, self.places = certain, places
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    """Bytes of one pretoken to ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if self._reachable(token, rank):
                self._add(token, rank)
        self.fits_memory: dict[int, bool] = {}
        self._forget()

    def _reachable(self, token: bytes, rank: int) -> bool:
        """Whether merging gives the token itself; notes its last merge."""
        if len(token) == 1:
            return True
        # Lower ranks are known: the token is made of the two that its own bytes end up as.
        lower = {k: self.ranks[k] for i in range(len(token)) for k in (token[i:j] for j in range(i + 2, len(token) + 1)) if self.ranks.get(k, rank) < rank}
        parts = merge_by_rank(token, lower)
        if len(parts) != 2:
            if merge_by_rank(token, self.ranks) == [token]:
                raise ValueError(f"token {token!r} is made of tokens of a higher rank; ranks must be in the order of merges")
            return False
        self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            child = self.children[node].get(byte)
            if child is None:
                child = len(self.children)
                self.children[node][byte] = child
                self.children.append({})
                self.token.append(-1)
            node = child
        self.token[node] = rank

    def _forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(-1, ((0, NOTHING),))

    def _state(self, certain: int, places: tuple) -> State:
        key = (certain, places)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(certain, places)
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, one after the other, stay these two.

        Undo their last merges, the later one first; a merge over the border that would have
        come before the merges undone breaks them. Of equal ranks the left one comes first.
        """
        if left < 0:
            return True
        key = left << 32 | right
        got = self.fits_memory.get(key)
        if got is None:
            got = self._fits(left, right)
            if len(self.fits_memory) >= 1_000_000:
                self.fits_memory.clear()
            self.fits_memory[key] = got
        return got

    def _fits(self, left: int, right: int) -> bool:
        before = 1 << 60
        while True:
            over = self.ranks.get(self.words[left] + self.words[right])
            if over is not None and over < before:
                return False
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                before, left = left, self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def _last(self, state: State, byte: int) -> tuple[int, ...]:
        """The open tokens with which the bytes up to this one end; of the places that a token
        leads from, the one that it fits behind."""
        for node, path in state.places:
            child = self.children[node].get(byte)
            if child is not None:
                token = self.token[child]
                if token >= 0 and self.fits(path[-1] if path else state.certain, token):
                    return (*path, token)
        raise ValueError(f"the vocabulary has no token for byte {byte}")

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        grown = []
        for node, path in state.places:
            child = self.children[node].get(byte)
            if child is not None and self.children[child]:
                grown.append((child, path))
        grown.append((0, self._last(state, byte)))
        first, agreed = grown[0][1], 0
        if len(grown) == 1:
            agreed = len(first)
        else:
            for at, token in enumerate(first):
                if any(len(path) <= at or path[at] != token for _, path in grown):
                    break
                agreed = at + 1
        certain = first[agreed - 1] if agreed else state.certain
        if len(self.states) >= MOST_STATES:
            self._forget()
        step = (self._state(certain, tuple((node, path[agreed:]) for node, path in grown)), first[:agreed])
        state.next[byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for at, byte in enumerate(piece[:-1]):
            step = state.next.get(byte)
            if step is None:
                # The first time this way: follow it without keeping it.
                state.next[byte] = AGAIN
                return out + self._rest(state, piece[at:])
            state, tokens = self._step(state, byte) if step is AGAIN else step
            if tokens:
                out += tokens
        out += self._last(state, piece[-1])
        return out

    def _rest(self, state: State, rest: bytes) -> list[int]:
        """The open tokens of a state and what follows on ``rest``, by the places alone."""
        places = [(node, path[-1] if path else state.certain, path) for node, path in state.places]
        children, tokens, fits = self.children, self.token, self.fits
        for byte in rest:
            grown, last = [], None
            for node, end, path in places:
                child = children[node].get(byte)
                if child is None:
                    continue
                if last is None:
                    token = tokens[child]
                    if token >= 0 and fits(end, token):
                        last = (0, token, (*path, token))
                if children[child]:
                    grown.append((child, end, path))
            if last is None:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
            grown.append(last)
            places = grown
        return list(places[-1][2])


class Codec:
    """Whole texts to packed ids (little-endian unsigned 32 bit) and back."""

    def __init__(self, path: str, pattern: str) -> None:
        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern)
        self.words = [self.machine.words.get(i, b"") for i in range(max(self.machine.words, default=-1) + 1)]
        self.piece = Memory(self._ids, 400_000)
        self.plain = Memory(self._pack, 100_000)
        self.blank = Memory(self._after_blank, 600_000)

    def _ids(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pack(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.split.findall(text)))

    def _after_blank(self, part: str) -> bytes:
        """A word after a blank; letters alone, or with one mark at the end, need no splitting."""
        if part.isalpha():
            return self._ids(" " + part)
        if part[:-1].isalpha() and part[-1] in ".,;:!?":
            return self.piece[" " + part[:-1]] + self.piece[part[-1]]
        return self._pack(" " + part)

    def encode(self, text: str) -> bytes:
        """Where a blank or a line end stands alone between other characters a piece begins for
        sure, so words are looked up by themselves; a text with longer runs is split as a whole."""
        out = []
        for part in segments(text):
            if _RUN.search(part):
                out.append(self._pack(part))
                continue
            for n, line in enumerate(part.split("\n")):
                if n:
                    out.append(self.plain["\n"])
                first, *rest = line.split(" ")
                if first:
                    out.append(self.plain[first])
                out += map(self.blank.__getitem__, rest)
        return b"".join(out)

    def decode(self, packed: bytes, step: int = 1 << 16) -> Iterator[str]:
        """The text in chunks. Bytes of a character may lie in several tokens or chunks: the UTF-8
        machine keeps what is open; what can't be text comes out as U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for at in range(0, len(packed), 4 * step):
            part = packed[at : at + 4 * step]
            ids = struct.unpack(f"<{len(part) // 4}I", part)
            yield machine.decode(b"".join(map(self.words.__getitem__, ids)))
        yield machine.decode(b"", final=True)


_RUN = re.compile(r"\s\s|\s$")
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process, so that what was learned serves the next task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    own = _CODECS[path, pattern]
    only(own.piece, own.plain, own.blank)
    return own


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str, keep: list[str], decode: bool = False) -> DataFrame:
    """``keep`` columns of every row with ``ids`` (packed little-endian unsigned 32 bit) and, on
    request, ``decoded``: the text that the ids give back.

    Rows are encoded where they lie, without a shuffle; every text as a whole. Null and empty
    texts give no ids. Equal rows give equal rows; an empty table gives an empty result.
    ``path`` must be readable on every executor.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    out = StructType([*(rows.schema[c] for c in keep), StructField("ids", BinaryType()), *([StructField("decoded", BinaryType())] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t.as_py()) for t in part.column("__text")]
                columns = [*(part.column(c) for c in keep), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(["".join(own.decode(i)).encode() for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return rows.mapInArrow(run, out)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``text``, decoded from packed ids; null ids are read as none."""
    rows = rows.select(*keep, F.coalesce(F.col(ids_col), F.lit(b"")).alias("__ids"))
    out = StructType([*(rows.schema[c] for c in keep)]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = ["".join(own.decode(i.as_py())) for i in batch.column("__ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[f.name for f in out])

    return rows.mapInArrow(run, out)
