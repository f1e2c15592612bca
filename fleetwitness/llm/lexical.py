"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

The items (queries) come in blocks of bounded size; for each block the documents are read once
and become an inverted index in small parts: a part holds the postings of the block's terms for a
few thousand documents. Counts that the weights need are summed over the parts. Every task then
scores its parts by itself: terms rarest first, one accumulator per document met. Before each term
the bounds of the terms to come (the largest contribution in this part) are added up; once a new
document could not reach the kth partial score any more, no accumulator is created, and the
documents that have one are scored to the end exactly. A task keeps the k best of each item over
all its parts, so what it returns does not grow with its input.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetwitness.llm.common import Steps, stored

#: A term is a run of ASCII letters and digits and of anything outside ASCII; A-Z are folded.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
CHUNK = 1 << 22
#: Pairs of item and term that one block of items holds; an item above it is a block of its own.
BLOCK_TERMS = 500_000
#: A part of the index ends at so many postings or documents.
PART_POSTINGS, PART_DOCS = 60_000, 20_000
#: So many parts are scored first, for a kth score that all tasks can start from.
OPENING_PARTS = 8
#: An item's rows are ranked in so many shares before they meet.
SHARES = 16


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    folded = (text or b"").translate(_FOLD)
    start = 0
    while len(folded) - start > CHUNK:
        end = folded.find(b" ", start + CHUNK)
        if end < 0:
            break
        yield folded[start:end].split()
        start = end
    yield (folded[start:] if start else folded).split()


_PART = "n_docs bigint, n_terms bigint, terms array<int>, counts array<int>, docs binary, tfs binary, sizes binary"


def _index(vocabulary) -> Callable:
    """Documents (id, text) to parts of the index over the terms of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        kind = None
        ids, sizes, widths, terms, tfs, n_docs, n_terms = [], [], [], [], [], 0, 0

        def part() -> pa.RecordBatch:
            term = np.array(terms, np.int32)
            order = np.argsort(term, kind="stable")
            found, counts = np.unique(term, return_counts=True)
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), widths)[order]
            columns = [
                pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()),
                pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32())),
                pa.array([doc.tobytes()]), pa.array([np.array(tfs, np.int64)[order].tobytes()]),
                pa.array([np.array(sizes, np.int64).tobytes()]), pa.array([ids], pa.list_(kind)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["n_docs", "n_terms", "terms", "counts", "docs", "tfs", "sizes", "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, held = 0, Counter()
                for some in terms_of(text):
                    size += len(some)
                    held.update(map(number, some))
                if not size:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + size
                held.pop(None, None)
                if held:
                    ids.append(key)
                    sizes.append(size)
                    widths.append(len(held))
                    terms.extend(held.keys())
                    tfs.extend(held.values())
                if len(terms) >= PART_POSTINGS or len(ids) >= PART_DOCS:
                    yield part()
                    ids, sizes, widths, terms, tfs, n_docs, n_terms = [], [], [], [], [], 0, 0
        if n_docs:
            yield part()

    return run


@dataclass
class _Plan:
    """What a task needs to score: items as (number, [(term, repeats)]) rarest first, and counts."""

    items: list[tuple[int, list[tuple[int, int]]]]
    weights: np.ndarray
    n: int
    total: int
    k: int
    floors: dict[int, int]


def _impacts(plan: _Plan, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 12 m)) of every posting."""
    m = np.array([75 + 25 * n * plan.n // plan.total for n in sizes.tolist()], np.int64)
    return np.repeat(plan.weights[terms], counts) * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs]))


def limited_scores(
    lists: list[tuple[np.ndarray, np.ndarray]], bounds: list[int], accumulators: np.ndarray, k: int, floor: int
) -> np.ndarray:
    """Scores ``lists`` of (documents, contributions), rarest first, into ``accumulators`` (zeros).

    Returns the documents that have an accumulator. All those that can be among the k best, or
    reach ``floor``, are among them with their exact score; others may be left out.
    """
    kth, rest, creating = floor, sum(bounds), True
    for (docs, gains), bound in zip(lists, bounds, strict=True):
        if creating and rest < kth:
            creating = False
        if not creating:
            known = accumulators[docs] > 0
            docs, gains = docs[known], gains[known]
        accumulators[docs] += gains
        rest -= bound
        if creating:
            partial = accumulators[accumulators > 0]
            if len(partial) >= k:
                kth = max(floor, int(np.partition(partial, -k)[-k]))
    return np.flatnonzero(accumulators)


def _order(row: tuple) -> tuple:
    score, key = row
    return (-score, key is None, key)


def _score(plan_of) -> Callable:
    """Parts of the index to the k best documents of each item in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: _Plan = plan_of.value
        best: dict[int, list[tuple[int, object]]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            rows = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                terms = rows["terms"][r].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(terms):
                    continue
                counts = rows["counts"][r].values.to_numpy(zero_copy_only=False)
                docs = np.frombuffer(rows["docs"][r].as_buffer(), np.int32)
                tfs = np.frombuffer(rows["tfs"][r].as_buffer(), np.int64)
                sizes = np.frombuffer(rows["sizes"][r].as_buffer(), np.int64)
                ids = rows["ids"][r].values
                gains = _impacts(plan, terms, counts, docs, tfs, sizes)
                ends = np.cumsum(counts)
                starts = ends - counts
                most = np.maximum.reduceat(gains, starts).tolist()
                place = dict(zip(terms.tolist(), range(len(terms)), strict=True))
                accumulators = np.zeros(len(ids), np.int64)
                for item, wanted in plan.items:
                    mine = [(place[t], q) for t, q in wanted if t in place]
                    if not mine:
                        continue
                    had = best.get(item, [])
                    floor = max(plan.floors.get(item, 0), had[-1][0] if len(had) == plan.k else 0)
                    bounds = [most[p] * q for p, q in mine]
                    if sum(bounds) < floor:
                        continue
                    lists = [(docs[starts[p] : ends[p]], gains[starts[p] : ends[p]] * q) for p, q in mine]
                    met = limited_scores(lists, bounds, accumulators, plan.k, floor)
                    scores = accumulators[met]
                    accumulators[met] = 0
                    good = scores >= max(floor, 1)
                    if len(scores) > plan.k:
                        good &= scores >= np.partition(scores, -plan.k)[-plan.k]
                    if good.any():
                        found = zip(scores[good].tolist(), ids.take(pa.array(met[good])).to_pylist(), strict=True)
                        best[item] = heapq.nsmallest(plan.k, [*had, *found], key=_order)
        if kind is not None:
            flat = [(item, score, key) for item, rows in best.items() for score, key in rows]
            item, score, key = zip(*flat, strict=True) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(key, kind)], names=["item", "score", "id"]
            )

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, Counter]]]:
    """Items with the counts of their terms, in blocks of bounded size; one block is held at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        terms = Counter()
        for some in terms_of(row["text"]):
            terms.update(some)
        if not terms:
            continue
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        block.append((row["id"], terms))
        held += len(terms)
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k highest-scoring documents of every item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and characters outside ASCII, A-Z in lower case. With N
    documents that hold a term, L terms in all, n in a document, df and tf of a term, its weight w is
    floor(1000 ln((2N+2)/(2df+1))), m is 75 + (25 n N div L), and a document gets w * ((10^9 tf) div
    (1000 tf + 12 m)) for every term of the item, repeats included. Only scores above 0 count; equal
    ones go by id, a null id last.

    A null, empty or blank text has no terms: such a document is never returned and counts nowhere,
    such an item has no rows. Every row is a document or an item of its own, so repeated rows get
    ranks of their own, and items that share an id share its rows' column only. Long texts are cut
    into terms in chunks. Columns other than the four named are not read, whatever their names. An
    empty table of either kind gives no rows.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    id_type, key_type = asked.schema["id"].dataType, texts.schema["id"].dataType.simpleString()
    found, out = None, f"item bigint, score bigint, id {key_type}"
    for block in _blocks(asked, block_terms):
        steps = Steps(spark)
        vocabulary = {term: n for n, term in enumerate(sorted({t for _, terms in block for t in terms}))}
        shared = context.broadcast(vocabulary)
        parts = steps.keep(texts.mapInArrow(_index(shared), f"{_PART}, ids array<{key_type}>"), "postings")
        n, total = parts.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if n:
            pairs = parts.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
            # As many rows as the block has terms at most.
            df = dict(pairs.groupBy("p.terms").agg(F.sum("p.counts")).collect())
            df = np.array([df.get(t, 0) for t in range(len(vocabulary))], np.int64)
            weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
            asking = [
                (at, sorted(((vocabulary[t], q) for t, q in terms.items()), key=lambda p: (df[p[0]], p[0])))
                for at, (_, terms) in enumerate(block)
            ]
            plan = _Plan(asking, weights, n, total, k, {})
            opening = parts.limit(OPENING_PARTS).mapInArrow(_score(context.broadcast(plan)), out)
            first: dict[int, list[int]] = {}
            for item, score in opening.select("item", "score").collect():
                first.setdefault(item, []).append(score)
            plan.floors = {item: sorted(scores)[-k] for item, scores in first.items() if len(scores) >= k}
            rows = parts.mapInArrow(_score(context.broadcast(plan)), out)
            order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
            share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
            rows = rows.withColumn("share", share)
            ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame(
                pa.table({"item": pa.array(range(len(block)), pa.int64()), "item_id": pa.array([key for key, _ in block], to_arrow_type(id_type))})
            )
            # The names are as many as the block has items.
            ranked = ranked.join(F.broadcast(names), "item").select(
                F.col("item_id").cast(id_type).alias(item_id), "rank", F.col("id").alias(id), "score"
            )
            ranked = stored(ranked, "ranked")
            found = ranked if found is None else found.unionByName(ranked)
        steps.drop("postings")
    if found is None:
        return spark.createDataFrame([], f"`{item_id}` {id_type.simpleString()}, rank int, `{id}` {key_type}, score bigint")
    return found
