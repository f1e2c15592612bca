"""Packing of token sequences: shortest pack first, over the histogram of lengths.

Documents are cut into full sequences and one rest each. The histogram of the rests has at most
one bin per length, whatever the number of documents; patterns of packs are made from it on the
driver, and the rests find their place by their rank among the rests of their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from fleetwitness.llm.common import stored
from fleetwitness.llm.spans import Memory, only, segments

#: Rows per cell of the rank count.
CELL_ROWS = 50_000


#: Latin letters and the marks behind them, which such a tokenizer treats apart.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
#: The steps before the merges for which that holds.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + n) for n, b in enumerate(hidden)}}


def _splits_letters(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer lower-cases, and takes a run of letters and one of marks as a word each."""
    steps = json.loads(tokenizer.to_str())
    normalizers = [n["type"] for n in (steps.get("normalizer") or {}).get("normalizers", [])]
    before = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = before[0].get("pattern", {}).get("Regex") if len(before) == 2 else None
    return normalizers == _NORMALIZERS and split == _SPLIT and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"]


class WordIds:
    """Ids of whole texts for a tokenizer that drops blanks: words between blanks are looked up.

    A word that is not known yet and has only Latin letters and marks is known by its letters, in
    whatever case and with whatever marks; only new runs of letters are merged, and they skip the
    steps before the merges, which change nothing in them.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model if _splits_letters(self.tokenizer) else None
        self.signs = _byte_signs()
        self.part = Memory(self._part, 500_000)
        self.letters = Memory(self._letters, 300_000)
        self.marks = Memory(self._pack, 10_000)

    def memories(self) -> tuple[Memory, ...]:
        return self.part, self.letters, self.marks

    def _part(self, part: str) -> bytes:
        plain = _PLAIN.match(part) if self.model is not None else None
        if plain is None:
            return self._pack(part)
        ids = self.letters[plain[1].lower()]
        return ids + self.marks[plain[2]] if plain[2] else ids

    def _letters(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join([self.signs[b] for b in letters.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pack(self, part: str) -> bytes:
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        out = []
        for segment in segments(text):
            out += map(self.part.__getitem__, segment.replace("\n", " ").split(" "))
        return b"".join(out)


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    only(*_IDS[path].memories())
    return _IDS[path]


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id, start, length, doc_tokens, ids_crc32, ids``: full pieces and the rest of every document.

    ``ids`` are packed, little-endian unsigned 32 bit; the document ends with ``end_id``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary"
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found: list[list] = [[] for _ in range(6)]
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    ids = own.encode(text.as_py()) + end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(found, (key, start, length, total, zlib.crc32(piece), piece), strict=True):
                            column.append(value)
                types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(found, types, strict=True)], names=["id", "start", "length", "doc_tokens", "ids_crc32", "ids"]
                )

    return rows.mapInArrow(run, out)


def pack_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths from front to back) and how many packs follow each.

    Lengths are placed longest first, each into the open packs that hold least so far. Packs of
    one pattern stay together as a count: what fits is moved to the longer pattern at once.
    """
    by_fill: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min((f for f, packs in by_fill.items() if packs and f + length <= size), default=None)
            if fill is None:
                by_fill[length][(length,)] = by_fill[length].get((length,), 0) + left
                break
            # All packs of this fill get one more before any gets a second one.
            grown: dict[tuple[int, ...], int] = {}
            for pattern in list(by_fill[fill]):
                take = min(left, by_fill[fill][pattern])
                by_fill[fill][pattern] -= take
                if not by_fill[fill][pattern]:
                    del by_fill[fill][pattern]
                grown[(*pattern, length)] = take
                left -= take
                if not left:
                    break
            for pattern, count in grown.items():
                by_fill[fill + length][pattern] = by_fill[fill + length].get(pattern, 0) + count
    return sorted(((p, n) for packs in by_fill.values() for p, n in packs.items()), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the rests of a length go."""
    out, ranks, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def pack(
    docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset``: one row per piece.

    A full piece is a sequence of its own. Rests are ranked inside their length in cells of
    bounded size (length and hash, counted first), so one length that holds a third of all rests
    is ranked by many tasks. The table of places grows with ``size``, not with the documents,
    and is the only thing broadcast.

    Null and empty texts are one piece that holds ``end_id``. Equal rows and rows with equal or
    null ids are packed each for itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, path, size, end_id, id_col, text_col), "pieces")
    rests = pieces.where(F.col("length") < size)
    rows = rests.count()
    cells = max(1, -(-rows // CELL_ROWS))
    rests = rests.withColumn("cell", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(cells)))
    counts = stored(rests.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell_starts = counts.select("length", "cell", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # < size rows
    patterns = pack_patterns(histogram, size)
    packs = sum(n for _, n in patterns)
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("id", "start", "ids_crc32"))
    ranked = rests.withColumn("inside", inside).join(cell_starts, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).withColumnRenamed("length", "len")
    table = spark.createDataFrame(places(patterns) or [(0, 0, 0, 0, 0)], "length bigint, first bigint, last bigint, sequence bigint, offset bigint")
    hit = (F.col("len") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(F.broadcast(table), hit).select(
        "id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
    full = pieces.where(F.col("length") == size).select(
        "id", "start", "length", "doc_tokens", "ids_crc32", "ids",
        (F.monotonically_increasing_id() + packs).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    return placed.unionByName(full)
