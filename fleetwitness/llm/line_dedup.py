"""Lines that repeat, exactly or nearly: an exact set-similarity join over their tokens.

A line is the set of its tokens, put in order of rarity. Two similar sets share a token in
their first few places (prefix filter), have sizes that allow the similarity (length filter),
and enough places behind the shared token (positional filter). Lines are named by 128 bits of their text and collapsed
to one row each, which is numbered, before their tokens are spread. What passes, and whose bits leave
room for the overlap, is verified on the full sets. Rarity comes from counts over all lines, by hash of the token; any fixed order gives
right results, a good one gives few candidates. The earliest lines of common tokens
of prefixes are tried first; after that only lines that are earlier than the best one can matter. All of it is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from fleetwitness.llm.common import Steps, whole_text

#: Counters of token hashes; the rarity table has this many entries however many tokens there are.
COUNTERS = 1 << 16
#: A line with more than one in this many of all occurrences is known to every task: there are
#: no more such lines than this.
HOT_SHARE = 1000
#: Up to so many hashes of lines (a few megabytes) are sent to all tasks, so that the texts need not move.
FEW_LINES = 500_000
#: Tokens at the end of a prefix whose earliest line is tried first.
TRIED = 3
LAST = (1 << 63) - 1


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, text, sid, sid2``: the lines between U+000A, numbered from 0, with 128 bits of hash."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(whole_text(text_col), "\n")).alias("line", "text"))
    # The second hash starts from another seed, so it does not follow from the first.
    return lines.withColumns({"sid": F.xxhash64("text"), "sid2": F.xxhash64(F.lit("line"), F.col("text"))})


def token_hashes(text: Column) -> Column:
    """The different tokens between U+0020 as hashes."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, " "), ""), lambda word: F.xxhash64(word)))


def rarity(lines: DataFrame) -> Column:
    """The logarithm of the count of each token counter, as a literal table."""
    words = lines.select(F.explode(F.split("text", " ")).alias("word"))
    slot = F.pmod(F.xxhash64("word"), F.lit(COUNTERS)).cast("int")
    rows = words.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()  # COUNTERS rows at most
    classes = ["0"] * COUNTERS
    for row in rows:
        classes[row["slot"]] = str(min(100, row["n"].bit_length()))
    return F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>")


def bits_of(part: int) -> Column:
    """64 of the 128 bits that the tokens of a line set, by their hashes."""
    return F.expr(
        f"aggregate(tokens, 0L, (a, h) -> a | CASE WHEN (h & 64) = {64 * part} THEN shiftleft(1L, cast(h & 63 AS INT)) ELSE 0L END)"
    )


def _missing(a: str, b: str) -> Column:
    """At least so many tokens of a are not in b: the bits that b has not set."""
    return sum((F.bit_count(F.expr(f"{a}_bits{k} & ~{b}_bits{k}")) for k in (0, 1)), F.lit(0))


def _needed(n: Column, share: str) -> Column:
    """Leading places that must hold a shared token: n less the least overlap, plus one."""
    return (n - F.expr(share) + 1).cast("int")


def _order(id_col: Column, kind: DataType) -> Column:
    """A number that never falls in the order of ids; the same for all where there is no cheap one."""
    number = id_col.cast("bigint") if isinstance(kind, IntegralType) else F.lit(0).cast("bigint")
    return F.coalesce(number, F.lit(LAST))


def _similar(steps: Steps, pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``x, y`` of lines, with their sizes, that are similar by their full sets."""
    wanted = steps.keep(pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct(), "line-wanted")
    few = F.broadcast(wanted) if wanted.count() <= FEW_LINES else wanted
    full = firsts.select("c", "text").join(few, "c").select("c", token_hashes(F.col("text")).alias("tokens"))
    full = steps.keep(full, "line-sets")
    checked = pairs.join(full.select(F.col("c").alias("x"), F.col("tokens").alias("x_tokens")), "x").join(
        full.select(F.col("c").alias("y"), F.col("tokens").alias("y_tokens")), "y"
    )
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return checked.where(both * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)


def _with_best(steps: Steps, rows: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``best``: the order of a similar line that is not later, or the last number.

    The earliest line of each of the commonest tokens of a prefix, which edits seldom touch, is
    tried; whatever this misses costs more pairs, never a link.
    """
    some = rows.where(F.col("place") >= F.col("probe") - TRIED)
    lead = some.groupBy("key").agg(F.min_by("c", "p").alias("y"), F.min("p").alias("y_p"), F.min_by("n", "p").alias("y_n"))
    fits = (F.least("n", "y_n") * 100 >= F.greatest("n", "y_n") * percent) & (F.col("c") != F.col("y"))
    tried = some.join(lead, "key").where(fits).select(F.col("c").alias("x"), "y", F.col("n").alias("x_n"), "y_n", "y_p").distinct()
    found = _similar(steps, steps.keep(tried, "line-pairs"), firsts, percent)
    best = steps.keep(found.groupBy(F.col("x").alias("c")).agg(F.min("y_p").alias("best")), "line-best")
    steps.drop("line-pairs", "line-wanted", "line-sets")
    few = F.broadcast(best) if best.count() <= FEW_LINES else best
    return rows.join(few, "c", "left").withColumn("best", F.coalesce("best", F.lit(LAST)))


def near_lines(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per line: ``id, line, first_id, first_line, kept``.

    A line is kept unless an earlier line, by (id, line number), has a token set with a Jaccard
    similarity of at least ``percent`` per cent; ``first_id, first_line`` is the earliest such
    line, or the line itself. Tokens are the parts between U+0020, case and marks included.

    Lines without tokens are linked with nothing and kept. Null text is one empty line. Null ids
    come after all others; equal rows are in an order of no consequence, as they hold the same
    lines: all but one of them are removed where the ids differ, none where id and line number
    are the same. An empty table gives an empty result. Columns other than these two are not
    read, whatever their names. Copies of a line are collapsed before the join, by partial aggregation.
    """
    steps = Steps(docs.sparkSession, tidy=True)
    lines = lines_of(docs, id_col, text_col)
    at = F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("line"))
    named = lines.groupBy("sid", "sid2").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("at"), F.first("text").alias("text"))
    # The numbers of lines are those in the table that is written.
    firsts = steps.keep(named.select(F.monotonically_increasing_id().alias("c"), "sid", "sid2", "copies", "at", "text"), "line-firsts")
    table = rarity(lines)
    # Rare first; the low bits of the hash order tokens of equal rarity.
    key = lambda h: F.shiftleft(F.element_at(table, (F.pmod(h, F.lit(COUNTERS)) + 1).cast("int")).cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    sets = firsts.select("c", _order(F.col("at.id"), docs.schema[id_col].dataType).alias("p"), token_hashes(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    ordered = sets.select("c", "p", F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", key)).alias("keys"), *[bits_of(k).alias(f"bits{k}") for k in (0, 1)])
    probe = _needed(F.col("n"), f"ceil(n * {percent} / 100)")
    prefixes = steps.keep(ordered.withColumn("keys", F.slice("keys", 1, probe)), "line-prefixes")
    rows = prefixes.select("c", "p", "n", "bits0", "bits1", F.size("keys").alias("probe"), F.posexplode("keys").alias("place", "key"))
    # A token that was counted once is in no other line.
    rows = rows.where(F.shiftright("key", 56) > 1)
    rows = _with_best(steps, rows, firsts, percent)
    # Both sides are the same rows, dealt once; the positional filter leaves the smaller set its shorter prefix.
    side = lambda s: rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("c", "p", "best", "n", "place", "bits0", "bits1")])
    overlap = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))  # at most, from here on
    enough = lambda o: o * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    larger = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_c") > F.col("y_c")))
    most = F.least(F.col("x_n") - _missing("x", "y"), F.col("y_n") - _missing("y", "x"))
    # Of two lines the later one needs the other only if that isn't behind its best one.
    early = F.least("x_p", "y_p") <= F.when(F.col("x_p") >= F.col("y_p"), F.col("x_best")).otherwise(F.col("y_best"))
    met = side("x").join(side("y"), "key").where(
        larger & early & (F.col("y_n") * 100 >= F.col("x_n") * percent) & enough(overlap) & enough(most)
    )
    pairs = steps.keep(met.select(F.col("x_c").alias("x"), F.col("y_c").alias("y"), "x_n", "y_n").distinct(), "line-pairs")
    links = steps.keep(_similar(steps, pairs, firsts, percent).select("x", "y"), "line-links")
    steps.drop("line-prefixes", "line-best", "line-pairs", "line-wanted", "line-sets")
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    nearest = both.join(firsts.select(F.col("c").alias("y"), "at"), "y").groupBy("x").agg(F.min("at").alias("other"))
    earliest = firsts.select("c", "sid", "sid2", "copies", "at").join(nearest.withColumnRenamed("x", "c"), "c", "left")
    earliest = steps.keep(earliest.select("sid", "sid2", "copies", F.least("at", "other").alias("first")), "line-earliest")
    steps.drop("line-firsts", "line-links")
    # The most frequent lines are answered where they are read; their rows carry keys that nothing meets.
    total = earliest.agg(F.sum("copies")).first()[0] or 0
    hot = earliest.where(F.col("copies") * HOT_SHARE > total).select("sid", "sid2", F.col("first").alias("hot_first"))
    blank = F.col("text").rlike("^ *$")
    placed = lines.select("id", "line", "sid", "sid2", blank.alias("blank")).join(F.broadcast(hot), ["sid", "sid2"], "left")
    is_hot = F.col("hot_first").isNotNull()
    placed = placed.select(
        "id", "line", "blank", "hot_first", F.when(is_hot, F.xxhash64("id", "line")).otherwise(F.col("sid")).alias("sid"),
        F.when(~is_hot, F.col("sid2")).alias("sid2"),
    )
    placed = placed.join(earliest.select("sid", "sid2", "first"), ["sid", "sid2"], "left").withColumn("first", F.coalesce("hot_first", "first"))
    own = F.struct(F.col("id").alias("id"), F.col("line").alias("line"))
    first = F.when(F.col("blank"), own).otherwise(F.struct(F.col("first.id").alias("id"), F.col("first.line").alias("line")))
    return placed.select("id", "line", first.alias("f")).select(
        "id", "line", F.col("f.id").alias("first_id"), F.col("f.line").alias("first_line"),
        (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("line") == F.col("f.line"))).alias("kept"),
    )
