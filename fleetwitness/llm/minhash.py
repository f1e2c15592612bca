"""Near duplicates by the chosen-path set similarity join.

Documents with equal shingle sets are one class. In each of several independent trees the
classes branch again and again by the smallest hash of their set under the function of that
tree and level; two similar sets take the same branch with a probability equal to their Jaccard
similarity. A small node is compared exhaustively by the minima of its classes; of a large one
all classes are compared with one of them, and unless that joins them up, it branches on. Nodes
that stay large and apart to the last level are compared exhaustively in blocks. What is likely
to be similar, over all trees, forms clusters; inside these the full sets decide. Rows of the
trees hold numbers of classes; one byte of each minimum joins them where classes are compared. A
task gives a spanning forest of what it finds, and in a crowd only those meet all others that its
pivots have not joined up, so that a crowd of near copies costs in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwitness.llm.common import Steps, components, stored
from fleetwitness.llm.spans import only
from fleetwitness.llm.words import WORD, mix, shingles, word_hashes

LEVELS = 4
#: The share of pairs at the threshold that may be missed where all their nodes are large to the last level.
MISSED = 1e-5
#: Smallest hashes kept of each set, or as many as the trees use; they use the first of them.
FUNCTIONS = 128
#: Classes of a node or cluster that are compared pair by pair in one task.
SMALL_NODE = 512
#: Pairs whose share of equal minima is so far below the threshold are not likely. With 128
#: minima a pair at the threshold of 0.85 falls under it about twice in a million.
SLACK = 0.14
#: Columns of the membership matrix at a time.
COLUMNS = 4096
#: Classes of a large cluster with which all its classes are compared before blocks meet.
PIVOTS = 4
#: Sets of pivots up to so many bytes are sent to all tasks, so that the other sets need not move.
PIVOT_BYTES = 16 << 20


def trees_for(percent: int) -> int:
    """Trees enough that a pair at the threshold stays together through all levels of one of them."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-min((percent / 100) ** LEVELS, 1 - MISSED))))


def functions_for(percent: int) -> int:
    return max(FUNCTIONS, trees_for(percent) * LEVELS)


def _multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(members: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The upper half of the smallest hash of a set under each function."""
    step = max(1, (1 << 20) // len(multipliers))
    low = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(members), step):
        np.minimum(low, np.multiply.outer(multipliers, members[at : at + step]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def _sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, key, n, minima, nodes, signature``: the key names the shingle set, nodes are those of the
    first level, the signature has the last byte of each minimum."""
    trees, levels, functions = trees_for(percent), LEVELS, functions_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(WORD)
        multipliers = _multipliers(functions)
        for batch in batches:
            keys, counts, lows, nodes, signs = [], [], [], [], []
            for text in batch.column("text"):
                members = np.unique(shingles(word_hashes(text.as_py()), size))
                low = minima(members, multipliers)
                keys.append(xxhash.xxh3_128_digest(members.tobytes()))
                counts.append(len(members))
                lows.append(low.tobytes())
                first = low[: trees * levels : levels].astype(np.uint64) + (np.arange(trees, dtype=np.uint64) << np.uint64(32))
                nodes.append(mix(first).astype(np.int64))
                signs.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(lows, pa.binary()),
                    pa.array(nodes, pa.list_(pa.int64())), pa.array(signs, pa.binary()),
                ],
                names=["id", "key", "n", "minima", "nodes", "signature"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key binary, n bigint, minima binary, nodes array<bigint>, signature binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``key, members``: the sorted shingle hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(word_hashes(text.as_py()), size)).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(m) for m in found], pa.binary()), pa.array(found, pa.binary())], names=["key", "members"]
            )

    return docs.select("text").mapInArrow(run, "key binary, members binary")



def _need(percent: int) -> int:
    return max(1, int(functions_for(percent) * (percent / 100 - SLACK)))


def _likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose minima agree often enough."""
    need, functions = _need(percent), functions_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, functions) for c in ("x", "y"))
            mask = pa.array((x == y).sum(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    left = signatures.select(F.col("c").alias("a"), F.col("signature").alias("x"))
    right = signatures.select(F.col("c").alias("b"), F.col("signature").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 2) -> Iterator[pa.Table]:
    """The rows of one group of ``by`` after another, of rows sorted by group; groups of ``least`` rows and more."""
    kept = None
    for batch in _and_none(batches):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
        if kept is None or not kept.num_rows:
            continue
        marks = [kept.column(c).combine_chunks() for c in by]
        new = np.zeros(kept.num_rows, bool)
        new[0] = True
        for mark in marks:
            new[1:] |= pc.not_equal(mark.slice(1), mark.slice(0, len(mark) - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(np.nonzero(new)[0], kept.num_rows)
        done = len(starts) - 1 if batch is None else len(starts) - 2
        for g in range(done):
            if starts[g + 1] - starts[g] >= least:
                yield kept.slice(starts[g], starts[g + 1] - starts[g])
        kept = kept.slice(starts[done])


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _forest(keys: list[int], left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links enough to connect what the links (by position) connect."""
    parent, a, b = list(range(len(keys))), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q:
            parent[p] = q
            a.append(keys[i])
            b.append(keys[j])
    return a, b


def _links_in_groups(rows: DataFrame, by: list[str], links_of) -> DataFrame:
    """``a, b``: a forest of ``links_of`` (a table to positions) in each group of ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            a, b = _forest(group.column("c").to_pylist(), *links_of(group))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint")


def _likely_in(percent: int):
    """Pairs of a group whose sizes allow the similarity and whose minima agree often enough."""
    need, functions = _need(percent), functions_for(percent)

    def links_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lows = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(group.num_rows, functions)
        sizes, left, right = group.column("n").to_numpy(), [], []
        for i in range(len(sizes) - 1):
            later = sizes[i + 1 :]
            fits = (later * 100 >= sizes[i] * percent) & (sizes[i] * 100 >= later * percent)
            if fits.any():
                hits = np.nonzero(fits)[0] + i + 1
                hits = hits[(lows[hits] == lows[i]).sum(axis=1) >= need]
                left.append(np.full(len(hits), i))
                right.append(hits)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    return links_of


def _similar_in(percent: int):
    """Pairs of a group whose full sets reach the similarity: all intersections at once, as the
    product of the membership matrix with itself, some columns at a time."""

    def links_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
        sizes = np.array([len(m) for m in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float64)
        width = int((count > 1).sum())
        for start in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
            part[owner[lo:hi], column[lo:hi] - start] = 1
            both += part @ part.T
        left, right = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
        return left, right

    return links_of


def _in_nodes(steps: Steps, rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of nodes that hold more than one class, with the number of ``rows`` and a ``pivot``.

    ``rows``: tree, node, c, n. The pivot depends on the tree."""
    first = F.min(F.struct(F.xxhash64("tree", "c").alias("h"), F.col("c")))
    nodes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), first.alias("first")).where("rows > 1")
    nodes = steps.keep(nodes.select(*by, "rows", F.col("first.c").alias("pivot")), "nodes")
    inside = steps.keep(rows.join(nodes, by), "inside")
    steps.drop("nodes")
    return inside


def likely_links(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a forest that connects classes whose minima agree, found in the nodes of the trees."""
    steps, by = Steps(classes.sparkSession), ["tree", "node"]
    inside = _in_nodes(steps, classes.select(F.posexplode("nodes").alias("tree", "node"), "c", "n"), by)
    signatures = classes.select("c", "signature")
    found = []
    for level in range(LEVELS):
        small = inside.where(F.col("rows") <= SMALL_NODE).select(*by, "c", "n").join(signatures, "c")
        large = inside.where((F.col("rows") > SMALL_NODE) & (F.col("c") != F.col("pivot")))
        more = bool(large.take(1))
        new = _links_in_groups(small, by, _likely_in(percent))
        if more:
            star = large.select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b")).distinct()
            new = new.unionByName(_likely(star, signatures, percent))
        found.append(stored(new, "cps-likely"))
        if not more:
            break
        roots = components(_all(found)).withColumnRenamed("node", "c")
        whole = inside.where(F.col("rows") > SMALL_NODE).select(*by, "c", "n").join(roots, "c", "left")
        whole = steps.keep(whole.withColumn("root", F.coalesce("root", "c")), "whole")
        apart = whole.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*by)
        apart = steps.keep(apart, "apart")
        if not apart.take(1):
            break
        rest = steps.keep(whole.join(apart, by), "rest")
        steps.drop("inside", "whole", "apart")
        if level == LEVELS - 1:
            blocks = _blocks(rest.join(signatures, "c"), by)
            found.append(stored(_links_in_groups(blocks, [*by, "i", "j"], _likely_in(percent)), "cps-likely"))
            break
        low = F.substring(F.col("minima"), (F.col("tree") * LEVELS + level + 1) * 4 + 1, F.lit(4))
        branched = rest.join(classes.select("c", "minima"), "c").select("tree", F.xxhash64("node", low).alias("node"), "c", "n")
        inside = _in_nodes(steps, branched, by)
        steps.drop("rest")
    steps.drop("inside", "whole", "apart", "rest")
    return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _pivot_links(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the links of the classes of each cluster ``root`` with its pivots, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("c", "members", "pivot", "pivot_members")]
            for c, members, pivot, pivot_members in zip(*columns, strict=True):
                x, y = np.frombuffer(members, np.uint64), np.frombuffer(pivot_members, np.uint64)
                # Both are sorted sets: every place of x in y that holds the same hash is a shared one.
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(c)
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rank = F.struct(F.xxhash64("c").alias("h"), F.col("c"))
    tops = rows.groupBy("root").agg(F.min(rank).alias("p0"))
    for k in range(1, PIVOTS):
        names = [f"p{i}" for i in range(k)]
        later = rows.join(tops, "root").where(rank > F.col(f"p{k - 1}")).groupBy("root").agg(F.min(rank).alias(f"p{k}"))
        tops = tops.join(later, "root", "left").select("root", *names, f"p{k}")
    picked = tops.select("root", F.explode(F.array(*[F.col(f"p{k}.c") for k in range(PIVOTS)])).alias("pivot")).where("pivot IS NOT NULL")
    sets = rows.select(F.col("c").alias("pivot"), F.col("members").alias("pivot_members"))
    steps = Steps(rows.sparkSession)
    picked = steps.keep(sets.join(picked, "pivot"), "pivots")
    size = picked.agg(F.sum(F.length("pivot_members"))).first()[0] or 0
    met = rows.join(F.broadcast(picked) if size <= PIVOT_BYTES else picked, "root").where("c <> pivot")
    links = stored(met.select("c", "members", "pivot", "pivot_members").mapInArrow(run, "a bigint, b bigint"), "cps-pivot-links")
    steps.drop("pivots")
    return links


def confirmed_links(docs: DataFrame, classes: DataFrame, likely: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: a forest of the links that the full sets confirm, inside the clusters of likely ones.

    Classes of a large cluster are compared with its pivots first; what these do not join up
    meets all others of its cluster in blocks."""
    steps = Steps(docs.sparkSession)
    clusters = components(likely).withColumnRenamed("node", "c")
    wanted = steps.keep(clusters.join(classes.select("c", "key", "id"), "c"), "wanted")
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    sets = _sets(docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi"), size)
    counts = steps.keep(wanted.groupBy("root").agg(F.count(F.lit(1)).alias("rows")), "counts")
    sized = steps.keep(wanted.select("key", "c", "root").join(counts, "root"), "sized")
    rows = steps.keep(sets.join(sized, "key").dropDuplicates(["key"]).drop("key"), "members")
    found = [stored(_links_in_groups(rows.where(F.col("rows") <= SMALL_NODE), ["root"], _similar_in(percent)), "cps-links")]
    large = rows.where(F.col("rows") > SMALL_NODE).drop("rows")
    if large.take(1):
        found.append(_pivot_links(large, percent))
        joined = components(found[-1]).toDF("c", "joined")
        spread = large.withColumnRenamed("root", "cluster").join(joined, "c", "left")
        spread = spread.withColumn("root", F.coalesce("joined", "c")).drop("joined")
        blocks = _blocks(spread, ["cluster"])
        found.append(stored(_links_in_groups(blocks, ["cluster", "i", "j"], _similar_in(percent)), "cps-links"))
    steps.drop("wanted", "counts", "sized", "members")
    return _all(found)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of groups of ``by`` dealt into pairs of blocks ``i, j`` of bounded size.

    ``root`` says what is joined up already. The rows of the largest root of a group do not meet
    each other again; each block of the others meets itself and every other block of its group in a
    group of its own. Groups that are one root give no rows."""
    of_root = rows.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n_root"))
    held = of_root.groupBy(*by).agg(F.max(F.struct("n_root", "root")).alias("main"), F.sum("n_root").alias("n_all"))
    per_block = lambda n: F.ceil(n * 2 / SMALL_NODE).cast("int")
    held = held.select(
        *by, F.col("main.root").alias("main"), per_block(F.col("n_all") - F.col("main.n_root")).alias("loose"),
        per_block(F.col("main.n_root")).alias("firm"),
    ).where("loose > 0")
    hashed, is_main = F.xxhash64("c"), F.col("root") == F.col("main")
    block = F.when(is_main, F.col("loose") + F.pmod(hashed, F.col("firm"))).otherwise(F.pmod(hashed, F.col("loose")))
    last = F.when(is_main, F.col("loose")).otherwise(F.col("loose") + F.col("firm")) - 1
    dealt = rows.join(held, by).withColumn("block", block.cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    marked = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return marked.drop("block", "other", "root", "main", "loose", "firm")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Links join documents whose sets of ``size``-word shingles have a Jaccard similarity of at
    least ``percent`` per cent. The component id is the smallest id that links reach. Recall: a
    pair at the threshold stays together in one tree with a probability of the threshold per level
    it needs. There are as many trees as it takes to miss it once in 10**5 where all its nodes are
    large and apart to the last level (16 at 85 per cent, 22 at 80), and far less often in small nodes.

    Null and empty texts and texts without words have no shingles and are linked with nothing.
    Rows with equal sets are linked whatever their ids; a null id is never a component's id
    unless all its members' are null. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    steps = Steps(docs.sparkSession)
    sketch = steps.keep(_sketch(docs, size, percent), "sketch")
    same = [F.first(c).alias(c) for c in ("n", "minima", "nodes", "signature")]
    classes = sketch.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), *same)
    # The numbers of classes are those in the table that is written.
    classes = steps.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    rows = stored(sketch.select("id", "key", "n"), "cps-rows")
    steps.drop("sketch")
    roots = components(confirmed_links(docs, classes, likely_links(classes, percent), size, percent))
    owned = classes.select("c", "key", "id").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    owned = steps.keep(owned, "owned")
    smallest = steps.keep(owned.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    named = stored(owned.join(smallest, "root").select("key", "component_id"), "cps-named")
    steps.drop("classes", "owned", "smallest")
    with_set = rows.where("n > 0").join(named, "key").select("id", "n", "component_id")
    without = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return with_set.unionByName(without).select(
        "id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked documents, with all its columns: the one with the
    smallest id, null after all others, then with the smallest hash of its text. Rows are told apart
    by id and text; documents without words all stay."""
    mark = F.md5(F.col(text_col).cast("string"))
    row = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), mark.alias("mark"))
    judged = near_duplicates(docs.select(row.alias("row"), F.col(text_col).alias("text")), size, percent, "row", "text")
    same = F.col(id_col).eqNullSafe(F.col("__row.id")) & (F.col("__mark") == F.col("__row.mark"))
    rows = docs.withColumn("__mark", mark)
    out = rows.join(judged.where("NOT kept").select(F.col("id").alias("__row")).distinct(), same, "left_anti")
    twice = judged.where("kept AND n_shingles > 0").groupBy(F.col("id").alias("__row")).count().where("count > 1").select("__row")
    if twice.take(1):  # one id in equal rows
        equal = out.join(twice, same, "left_semi").dropDuplicates([id_col, "__mark"])
        out = out.join(twice, same, "left_anti").unionByName(equal)
    return out.drop("__mark")
