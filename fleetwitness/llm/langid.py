"""Language by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from fleetwitness.llm.spans import only
from fleetwitness.operators.ordered import small_side

UNDETERMINED = "und"
LEVEL = 5
#: For texts whose sizes tie, as very short ones that no dictionary makes smaller: what they add
#: to the end of each dictionary's content.
FINE_LEVEL = 19
FINE_BYTES = 16384
BLOCK_BYTES = 65536
HASH_PLACES = 1 << 40

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Words in lower case, whatever stands between them as one blank."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def held_out(id_col: str) -> Column:
    """Rows whose id is never learned from: crc32 of the id as text, mod 3, is 1. Null id: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_dictionaries(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = 400, slice_chars: int = 400
) -> dict[str, bytes]:
    """Raw-content dictionaries, one per language, from a bounded sample of the labelled rows.

    Bound: of every language the ``sample_docs`` rows with the smallest hash of their id give
    one slice of ``slice_chars`` characters each, from a place that the hash names as well.
    The languages are counted first, so that only about four times as many rows as are wanted
    leave the scan, however large a language is. Rows without text or language teach nothing.
    """
    text, size = F.col(text_col), F.lit(slice_chars)
    room = F.greatest(F.char_length(text) - size, F.lit(0)) + 1
    usable = labelled.where(text.isNotNull() & F.col(lang_col).isNotNull() & (text != ""))
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(HASH_PLACES))
    known = usable.select(
        F.col(lang_col).alias("lang"),
        place.alias("h"),
        F.substring(text, (F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), room) + 1).cast("int"), size).alias("part"),
    )
    # A language's share of the places, from its count; no language is named at the driver.
    limits = known.groupBy("lang").agg(F.greatest(F.lit(1), (F.lit(HASH_PLACES * 4.0 * sample_docs) / F.count(F.lit(1))).cast("bigint")).alias("limit"))
    pick = known.join(small_side(limits), "lang").where(F.col("h") <= F.col("limit"))
    order = Window.partitionBy("lang").orderBy("h", "part")
    rows = pick.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in rows:
        parts.setdefault(row["lang"], []).append((row["rank"], row["part"]))
    return {lang: b"\n".join(letters(p) for _, p in sorted(own)) for lang, own in sorted(parts.items())}


class Sizes:
    """Compressed sizes of a whole text under each dictionary, in blocks of fixed size."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(lang for lang, data in dictionaries.items() if data)
        self.by = [(lang, self._compressor(dictionaries[lang])) for lang in self.langs]
        small = zstandard.ZstdCompressionParameters.from_level(FINE_LEVEL, source_size=FINE_BYTES + BLOCK_BYTES, write_content_size=False)
        self.fine = zstandard.ZstdCompressor(compression_params=small)
        ends = [(lang, dictionaries[lang][-FINE_BYTES:]) for lang in self.langs]
        self.ends = [(lang, end, len(self.fine.compress(end))) for lang, end in ends]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=BLOCK_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        data.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def ranked(self, text: str) -> list[tuple[int, str]]:
        data = letters(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by)
        if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
            sizes = sorted((sum(len(self.fine.compress(end + b)) - alone for b in blocks), lang) for lang, end, alone in self.ends)
        return sizes

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, margin); the margin is the saving over the second language's size."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        ranked = self.ranked(text)
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        low, high = max(0, ranked[0][0]), max(1, ranked[1][0])
        return ranked[0][1], 1.0 - low / high if low < high else 0.0


JUDGED = ("lang_pred", "score", "rejected")


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text_col: str, keep: list[str], min_margin: float = 0.0, names: tuple[str, str, str] = JUDGED
) -> DataFrame:
    """``keep`` columns of every row with language, score and rejection under ``names``; the text
    alone decides. Where ``keep`` has a column of such a name, give other ``names``.

    Each row is judged where it lies, in blocks, with no shuffle. Null text, empty text and text
    without a letter give ``und`` with score 0 and are rejected. So is a text whose margin is
    below ``min_margin``. A tie goes to the alphabetically first language with margin 0. With no
    dictionary all rows are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    out = StructType([rows.schema[c] for c in keep]).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        sizes = Sizes(shared.value)
        for batch in batches:
            found = [sizes.best(t.as_py()) for t in batch.column("__text")]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] == UNDETERMINED or f[1] < min_margin for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[f.name for f in out])

    return rows.mapInArrow(judge, out)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.0) -> DataFrame:
    """Fit on the rows that are not held out, then judge every row: ``id, held_out, lang_pred, score, rejected``.

    Columns other than the three named are not read, whatever their names.
    """
    learned = fit_dictionaries(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return identify(rows, learned, "text", ["id", "held_out"], min_margin)
