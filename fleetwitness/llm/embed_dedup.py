"""Near duplicates among embeddings by sorted projection passes.

In each pass the vectors are put in the order of a key of many random hash bits (signs of
projections). Neighbours in that order are compared: all within a window of ranks, and all that
share the leading bits, so that a crowd of near copies larger than the window is compared in
full. Both conditions can be read from a vector's ranks and bits in all passes, which travel
with it; a pair is judged in the first pass that brings it together and nowhere else. So link
counts add up without a list of the pairs, and a task gives counts and a spanning forest only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwitness.llm.common import components, stored

#: Ranks on either side within which vectors are compared.
WINDOW = 128
#: Vectors of one comparison group.
TILE = 1024
KEY_BITS = 48


def passes_for(vectors: int, cosine: float, recall: float, window: int = WINDOW) -> tuple[int, int]:
    """(passes, leading bits): a pair at ``cosine`` shares as many leading bits as make a crowd of
    a window's size, in at least one pass, with the probability ``recall``."""
    bits = min(KEY_BITS, max(1, math.ceil(math.log2(max(2, vectors) / window)))) if vectors > window else 1
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))), bits


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, key, vec``: packed doubles and their 128-bit hash; both null where nothing can be compared."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed = [], []
            for value in batch.column("vec"):
                vec = np.array(value.as_py() or [], np.float64)  # None becomes NaN
                with np.errstate(all="ignore"):
                    norm = math.sqrt(float(((vec / scale) ** 2).sum())) if len(vec) and np.isfinite(vec).all() and (scale := np.abs(vec).max()) > 0 else 0.0
                if norm > 0:
                    unit = (vec / scale / norm).tobytes()
                    keys.append(xxhash.xxh3_128_digest(vec.tobytes()))
                    packed.append(unit)
                else:
                    keys.append(None)
                    packed.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["id", "key", "vec"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, vec binary")


def _projected(classes: DataFrame, passes: int) -> DataFrame:
    """``pass, bits, key``: the sort key of every vector in every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.left_shift(1, np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            keys, out = batch.column("key").to_pylist(), np.empty((batch.num_rows, passes), np.int64)
            for i, vec in enumerate(batch.column("vec").to_pylist()):
                vec = np.frombuffer(vec)
                if len(vec) not in planes:
                    planes[len(vec)] = np.random.default_rng(20_000 + len(vec)).standard_normal((passes * KEY_BITS, len(vec)))
                out[i] = (planes[len(vec)] @ vec > 0).reshape(passes, KEY_BITS) @ weights
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(passes, dtype=np.int32), len(keys))),
                    pa.array(out.ravel()),
                    pa.array([k for k in keys for _ in range(passes)], pa.binary()),
                ],
                names=["pass", "bits", "key"],
            )

    return classes.select("key", "vec").mapInArrow(run, "pass int, bits bigint, key binary")


def _ranked(projected: DataFrame, passes: int) -> DataFrame:
    """``pass, bits, key, rank``: the place in the order of each pass, from 0.

    Ranges of (pass, bits, key) are sorted by a task each; a crowd of equal bits is cut like any
    other range. The rows per range and pass, a table as long as there are ranges, give the rest.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), dict.fromkeys(range(passes), 0)
        for batch in batches:
            inside = []
            for p in batch.column("pass").to_pylist():
                inside.append(seen[p])
                seen[p] += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(inside, pa.int64())], names=["pass", "bits", "key", "part", "inside"]
            )

    order = ["pass", "bits", "key"]
    ranges = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = projected.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = stored(rows.mapInArrow(number, "pass int, bits bigint, key binary, part int, inside bigint"), "embed-ranges")
    counts = stored(rows.groupBy("pass", "part").agg(F.count(F.lit(1)).alias("n")), "embed-counts")
    up = Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pass", "part", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    return rows.join(starts, ["pass", "part"]).select(*order, (F.col("before") + F.col("inside")).alias("rank"))


def _compare(cosine: float, window: int, passes: int):
    """Links of one group: counts per vector and the edges of a spanning forest."""

    def run(rows: pa.Table) -> pa.Table:
        now, crowd = rows.column("pass")[0].as_py(), rows.column("block")[0].as_py() >= 0
        keys, weight = rows.column("key").to_pylist(), rows.column("copies").to_numpy()
        side = rows.column("side").to_numpy()
        ranks = np.frombuffer(b"".join(rows.column("ranks").to_pylist()), np.int64).reshape(len(keys), passes)
        bits = np.frombuffer(b"".join(rows.column("leads").to_pylist()), np.int64).reshape(len(keys), passes)
        packed = rows.column("vec").to_pylist()
        sizes = np.array([len(v) for v in packed])
        left, right = [], []
        for size in np.unique(sizes):  # vectors of different length have no cosine
            mine = np.nonzero(sizes == size)[0]
            x = np.frombuffer(b"".join(packed[i] for i in mine)).reshape(len(mine), -1)
            for at in range(0, len(mine), 256):
                a, b = np.nonzero(x[at : at + 256] @ x.T >= cosine)
                left.append(mine[a + at])
                right.append(mine[b])
        left, right = np.concatenate(left), np.concatenate(right)
        # A pair is met once: in rank order, and on one side of the group at most if that has two.
        step = ranks[right, now] - ranks[left, now]
        keep = step > window if crowd else (step > 0) & (step <= window) & (side[left] == 0)
        if crowd:
            keep &= (side[left] == 0) | (side[left] != side[right])
        left, right = left[keep], right[keep]
        for p in range(now):
            fresh = (np.abs(ranks[left, p] - ranks[right, p]) > window) & (bits[left, p] != bits[right, p])
            left, right = left[fresh], right[fresh]
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, left, weight[right])
        np.add.at(links, right, weight[left])
        parent = list(range(len(keys)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a_keys, b_keys = [], []
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            p, q = root(i), root(j)
            if p != q:
                parent[p] = q
                a_keys.append(keys[i])
                b_keys.append(keys[j])
        some = np.nonzero(links)[0].tolist()
        return pa.table(
            {
                "key": pa.array([keys[i] for i in some] + a_keys, pa.binary()),
                "links": pa.array([int(links[i]) for i in some] + [0] * len(a_keys), pa.int64()),
                "other": pa.array([None] * len(some) + b_keys, pa.binary()),
            }
        )

    return run


def near_vectors(
    df: DataFrame, cosine: float = 0.9, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Links join vectors with a cosine of at least ``cosine``, in double precision. The number of
    passes follows the number of vectors so that a pair right at the limit is met with the
    probability ``recall``; closer pairs are met more surely. No link below the limit is given.

    Equal vectors are one class with a count. Vectors that are null, empty, zero, or hold a null
    or a value that isn't finite link with nothing; neither do vectors of different length.
    ``n_links`` counts rows, so copies of a row are links of each other. A component's id is its
    smallest id; a null id only if it has no other. An empty table gives an empty result.
    """
    rows = stored(_vectors(df, id_col, vector_col), "embed-rows")
    classes = stored(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")),
        "embed-classes",
    )
    passes, bits = passes_for(classes.count(), cosine, recall)
    lead = F.shiftright("bits", KEY_BITS - bits)
    ranked = stored(_ranked(_projected(classes, passes), passes).withColumn("lead", lead).drop("bits"), "embed-ranks")
    hold = F.array_sort(F.collect_list(F.struct("pass", "rank", "lead")))
    pack = F.udf(lambda values: np.asarray(values, np.int64).tobytes(), "binary", useArrow=True)
    places = ranked.groupBy("key").agg(hold.alias("at"))
    full = stored(
        classes.join(places, "key").select(
            "key", "copies", "vec", F.col("at.rank").alias("rank_list"), F.col("at.lead").alias("lead_list"),
            pack(F.col("at.rank")).alias("ranks"), pack(F.col("at.lead")).alias("leads"),
        ),
        "embed-full",
    )
    each = full.select(
        "key", "copies", "vec", "ranks", "leads", F.posexplode(F.arrays_zip("rank_list", "lead_list")).alias("pass", "at")
    ).withColumns({"rank": F.col("at.rank_list"), "lead": F.col("at.lead_list")})
    carried = ["key", "copies", "vec", "ranks", "leads"]
    tile = F.floor(F.col("rank") / TILE)
    guest = F.when((F.col("rank") % TILE < WINDOW) & (tile > 0), F.struct((tile - 1).alias("i"), F.lit(1).alias("side")))
    spots = F.explode(F.filter(F.array(F.struct(tile.alias("i"), F.lit(0).alias("side")), guest), lambda s: s.isNotNull()))
    near = each.select("pass", F.lit(-1).cast("bigint").alias("block"), spots.alias("s"), *carried).select(
        "pass", "block", F.col("s.i").alias("i"), F.col("s.i").alias("j"), F.col("s.side").alias("side"), *carried
    )
    # Crowds: more vectors share their leading bits than a window holds.
    crowds = stored(
        ranked.groupBy("pass", "lead").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).where(F.col("n") > WINDOW + 1), "embed-crowds"
    )
    mine = F.floor((F.col("rank") - F.col("first")) / TILE)
    last = F.floor((F.col("n") - 1) / TILE)
    crowded = each.join(crowds, ["pass", "lead"]).withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0).cast("bigint"), last))}).select(
        "pass", F.col("lead").cast("bigint").alias("block"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), *carried,
    )
    found = near.unionByName(crowded).groupBy("pass", "block", "i", "j").applyInArrow(_compare(cosine, WINDOW, passes), "key binary, links bigint, other binary")
    found = stored(found, "embed-found")
    links = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL"), "key", "other").withColumnRenamed("node", "key")
    owned = classes.select("key", "id", "copies").join(links, "key", "left").join(roots, "key", "left")
    owned = stored(owned.withColumn("root", F.coalesce("root", "key")), "embed-owned")
    smallest = stored(owned.groupBy("root").agg(F.min("id").alias("component_id")), "embed-smallest")
    count = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = stored(owned.join(smallest, "root").select("key", count, "component_id"), "embed-named")
    linked = rows.where("key IS NOT NULL").join(named, "key").select("id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
