"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton lists every vocabulary entry that ends at a place of the text; the
Viterbi recursion carries the best score and the number of pieces, nothing else. Ties: a later
candidate must score strictly more, and candidates come by their start, so of equal paths the
one with the longest last piece stays. A character without an entry of its own costs the lowest
score of the vocabulary less ten; runs of such characters count as one piece, or one per byte
where the vocabulary falls back to bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetwitness.llm.spans import Memory, only, segments

UNKNOWN_PENALTY = 10.0
WORD_START = "▁"
_WORD = re.compile(f"{WORD_START}+[^{WORD_START}]*")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Entries that text can match, with their scores, and whether unknown characters become bytes.

    Control, unknown and byte entries stand for no text.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(map(model.is_byte, ids))


class Counter:
    """Number of pieces of whole texts."""

    def __init__(self, vocabulary: list[tuple[str, float]], to_bytes: bool) -> None:
        self.scores = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.scores.add_word(piece, (len(piece), score))
        self.scores.make_automaton()
        self.bytes = to_bytes
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        # No entry goes on with a word start after other characters: then words can be counted alone.
        self.apart = all(WORD_START not in piece.lstrip(WORD_START) for piece, _ in vocabulary)
        self.word = Memory(self._viterbi)

    def _viterbi(self, text: str) -> int:
        size = len(text)
        best: list[float | None] = [0.0] + [None] * size
        pieces = [0] * (size + 1)
        unknown = [False] * (size + 1)  # the best path ends with an unknown character
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.scores.iter(text):
            ends[end].append(match)
        for end in range(size):
            top, alone = None, False
            for length, score in sorted(ends[end], reverse=True):
                total = score + best[end + 1 - length]
                alone = alone or length == 1
                if top is None or total > top:
                    top, start = total, end + 1 - length
            if not alone:
                total = self.unknown + best[end]
                if top is None or total > top:
                    best[end + 1] = total
                    unknown[end + 1] = True
                    if self.bytes:
                        pieces[end + 1] = pieces[end] + len(text[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces[end + 1] = pieces[end] + (not unknown[end])
                    continue
            best[end + 1], pieces[end + 1] = top, pieces[start] + 1
        return pieces[size]

    def count(self, text: str) -> int:
        """Blanks become word starts and one more precedes the text; an empty text has no pieces."""
        if not text:
            return 0
        if not self.apart:
            return self._viterbi(WORD_START + text.replace(" ", WORD_START))
        total = 0
        for n, part in enumerate(segments(text)):
            marked = part.replace(" ", WORD_START)
            total += sum(map(self.word.__getitem__, _WORD.findall(marked if n else WORD_START + marked)))
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(*read_vocabulary(path))
    only(_COUNTERS[path].word)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``n_tokens``, counted over the whole text.

    Rows are counted where they lie, without a shuffle. Null and empty texts have 0 tokens.
    Equal rows give equal rows; an empty table gives an empty result. ``path`` must be readable
    on every executor.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    out = StructType([*(rows.schema[c] for c in keep), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = pa.array([own.count(t.as_py()) for t in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[f.name for f in out])

    return rows.mapInArrow(run, out)
