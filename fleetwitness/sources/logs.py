"""Text logs: exact in-file order, byte offsets, and the parts of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import message_pairs, message_token, time_of_day_ms
from fleetwitness.operators.ordered import Ordered, in_segments, last_upto, ordered, row_index, running_sum

# Fixed value: the form of a stamped line.
MARK = "\u0001"
# The mark may stand in a message only.
LINE = r"^(\d{2}:\d{2}:\d{2}\.\d+) \[([^\]\x01]*)\] ([^\s\x01]+) ([^\s\x01]+) -- (.*)$"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``file, idx`` (from 0), ``byte_off, text``.

    A file split is a natural segment: lines are numbered inside their split and
    the counts of the earlier splits are added, so no task holds a whole file.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("line_id"),
            F.col("value").alias("text"),
        )
    )
    size = F.octet_length("text") + 1
    seq = in_segments(lines, ["file"], "split_start", ["line_id"]).scan(
        _n=row_index(), _bytes=running_sum(size.cast("bigint"))
    )
    return seq.frame().select(
        "file", (F.col("_n") - 1).alias("idx"), (F.col("_bytes") - size).alias("byte_off"), "text"
    )


def parse_log_line(lines: DataFrame) -> DataFrame:
    """Add stamp, thread, level, logger, message, token and pairs; NULL where absent.

    One regular expression per line cuts it into its parts. A line of that form keeps
    its message even if that is empty; any other line is a message as a whole.
    """
    # No line of the form starts with the mark, so a cut line is told by it.
    cut = F.regexp_replace("text", LINE, f"{MARK}$1{MARK}$2{MARK}$3{MARK}$4{MARK}$5")
    formed = F.col("text").rlike(r"^\d{2}:") & cut.startswith(MARK)
    parts = lines.withColumn("_parts", F.when(formed, F.split(cut, MARK, 6)))

    def part(n: int) -> Column:
        return F.get("_parts", F.lit(n + 1))

    named = parts.withColumns(
        {
            **{name: F.nullif(part(n), F.lit("")) for n, name in enumerate(("thread", "level", "logger"), 1)},
            "message": F.when(F.col("_parts").isNotNull(), part(4)).otherwise(F.col("text")),
        }
    ).drop("_parts")
    return named.withColumns(
        {
            "tod_ms": time_of_day_ms(F.col("text")),
            "token": message_token(F.col("message")),
            "kv": message_pairs(F.col("message")),
        }
    )


def carry_stamp(lines: DataFrame | Ordered, key: str = "boot_id") -> DataFrame:
    """An unstamped line takes the stamp of the line above it."""
    seq = lines if isinstance(lines, Ordered) else ordered(lines, [key], ["idx"])
    return seq.scan(carried_ms=last_upto("tod_ms")).frame()


def split_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of a text column in order: ``key, idx, text``."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("idx", "text"))
    return rows.withColumn("idx", F.col("idx").cast("bigint"))


def with_offsets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Byte offset of every line in its log, counting one byte for each line end."""
    size = (F.octet_length("text") + 1).cast("bigint")
    seq = ordered(lines, keys, ["idx"]).scan(_end=running_sum(size))
    return seq.with_columns({"byte_off": F.col("_end") - size}).drop("_end").frame()
