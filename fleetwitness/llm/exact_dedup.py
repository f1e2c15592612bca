"""Exact duplicates: group by a 128-bit content hash, compare the bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.llm.common import BLANKS, stored, whole_text


def squeezed(text: Column) -> Column:
    """The text without any blank of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256, n_points``.

    Rows belong together when their texts hold the same bytes after blanks are deleted. Of a
    group the row with the most code points in its original text stays, then the smallest id.

    Texts are grouped by (hash, bytes), so a collision of the hash can't join two texts. Copies
    are combined before the shuffle: a group with a third of all rows sends one row per task.
    Rows find their group by the hash alone; only where one hash has several texts, by the text.

    Null text is empty; all empty texts form one group. Rows with equal ids are rows of their
    own (both count, both are kept if their id stays). A null id loses to any other and is
    kept only where its whole group has none. An empty table gives an empty result. Extra
    columns are ignored, whatever their names.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), squeezed(text).alias("body"), F.char_length(text).alias("n_points"))
    rows = rows.withColumn("hash", content_hash(F.col("body")))
    keyed = stored(rows.select("id", "hash", "n_points", F.sha2("body", 256).alias("text_sha256")), "exact-rows")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("z"), F.col("id")))
    classes = rows.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = stored(
        classes.select("hash", "group_size", F.col("best.id").alias("keep_id"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id")),
        "exact-groups",
    )
    out = keyed.join(groups.where("texts = 1"), "hash")
    shared = groups.where("texts > 1").select("hash")
    if shared.take(1):  # the hash of different texts collided: here the bytes decide
        again = rows.join(shared, "hash").withColumn("text_sha256", F.sha2("body", 256))
        own = stored(
            again.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "exact-collided"
        ).select("hash", "body", "group_size", F.col("best.id").alias("keep_id"))
        out = out.select("id", "keep_id", "group_size", "text_sha256", "n_points").unionByName(
            again.join(own, ["hash", "body"]).select("id", "keep_id", "group_size", "text_sha256", "n_points")
        )
    return out.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_points"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns."""
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.where("NOT kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__gone")).distinct()
    rows = docs.withColumn("__sha", F.sha2(squeezed(whole_text(text_col)), 256))
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__gone")), "left_anti")
    if groups.where("kept").groupBy("id", "text_sha256").count().where("count > 1").take(1):  # one id in equal rows
        rows = rows.dropDuplicates([id_col, "__sha"])
    return rows.drop("__sha")
