"""URL filter: rules on host and path first, then a ratio of two character language models.

The models are smoothed Markov models of variable order: Witten-Bell interpolation from the
longest context that was seen down to single characters. Accepted and rejected URLs, as the
rules judge them, train one model each; a held-out fold of the same URLs calibrates the limit
on the length-normalised difference of the log-likelihoods. All work is column expressions,
aggregations and equality joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.llm.common import stored

#: (verdict, host, path)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
#: Weight of a character that no model has seen: one in the code points of the basic plane.
UNSEEN = 1.0 / 65536
START, END = "\x02", "\x03"
#: Scores are binned for the calibration; the number of bins bounds what the driver sees.
BIN, MOST_BIN = 0.01, 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def _choose(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), rule_name(r))):
        _, name, start = rule
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def grams_of(text: Column) -> Column:
    """For every character of the text and its end: the character after its ``ORDER`` predecessors."""
    chars = F.split(F.concat(F.lit(START * ORDER), text, F.lit(END)), "")
    places = F.sequence(F.lit(0), F.size(chars) - ORDER - 1)
    return F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(ORDER + 1)]))


def gram_scores(counts: DataFrame) -> DataFrame:
    """``gram, weight``: log P(accepted model) - log P(rejected model) of its last character.

    ``counts``: ``gram, yes, no``, one row per distinct gram. Each order is one aggregation of
    the order above, joined with its contexts and with the order below.
    """
    below = None
    for order in range(ORDER + 1):
        part = F.substring("gram", ORDER + 1 - order, order + 1)
        rows = counts.groupBy(part.alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        rows = rows.withColumn("ctx", F.substring("g", 1, order)).withColumn("short", F.substring("g", 2, order))
        seen = rows.groupBy("ctx").agg(
            F.sum("yes").alias("yes_n"), F.sum("no").alias("no_n"),
            F.sum((F.col("yes") > 0).cast("long")).alias("yes_t"), F.sum((F.col("no") > 0).cast("long")).alias("no_t"),
        )
        rows = rows.join(seen, "ctx")
        if below is None:
            rows = rows.withColumn("yes_p", F.lit(UNSEEN)).withColumn("no_p", F.lit(UNSEEN))
        else:
            rows = rows.join(below, "short")

        def smooth(k: str) -> Column:
            count, total, kinds, lower = F.col(k), F.col(f"{k}_n"), F.col(f"{k}_t"), F.col(f"{k}_p")
            return F.when(total > 0, (count + kinds * lower) / (total + kinds)).otherwise(lower)

        below = rows.select(F.col("g").alias("short"), smooth("yes").alias("yes_p"), smooth("no").alias("no_p"))
    return below.select(F.col("short").alias("gram"), (F.log("yes_p") - F.log("no_p")).alias("weight"))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The score with the best mean of both classes' hit rates; ``bins``: (bin, accepted, rejected).

    Limits lie in the middle between two bins that hold rows. Without calibration rows of both
    classes it is 0. Of equally good limits the one nearest 0 counts.
    """
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return 0.0
    best, at, below_yes, below_no, last = (-1.0, 0.0), 0.0, 0, 0, None
    for edge, y, n in [*sorted(bins), (None, 0, 0)]:
        limit = (last + 1 if edge is None else edge if last is None else (last + 1 + edge) / 2) * BIN
        quality = (round((yes - below_yes) / yes + below_no / no, 9), -abs(limit))
        if quality > best:
            best, at = quality, limit
        below_yes, below_no, last = below_yes + y, below_no + n, edge
    return at


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict, score``.

    The rule with the longest name that fits gives the verdict; else the models do: allow when
    the score reaches the calibrated limit. Equal URLs are scored once. Grams meet their weights
    in a join of two plain tables, so that a gram of every URL is split by the adaptive skew join.

    A null URL is read as empty: host and path are empty, no rule fits, and the models judge the
    empty text. Without URLs of both classes all scores are 0 and the rest is allowed. An empty
    table gives an empty result; equal rows give equal rows.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select(
        "url", "n", host.alias("host"), path.alias("path"),
        _choose(host, path, rules, lambda r: r[0]).alias("ruled"), _choose(host, path, rules, rule_name).alias("rule"),
    )
    urls = stored(urls.withColumn("calibrates", F.pmod(F.xxhash64("url"), F.lit(5)) == 0), "urls")
    each = urls.select("url", "n", "ruled", "calibrates", F.explode(grams_of(F.col("url"))).alias("gram"))
    learns = lambda verdict: F.sum(F.when((F.col("ruled") == verdict) & ~F.col("calibrates"), F.col("n")).otherwise(0))
    counts = stored(each.groupBy("gram").agg(learns("allow").alias("yes"), learns("block").alias("no")), "url-grams")
    weights = stored(gram_scores(counts), "url-weights")
    summed = each.select("url", "gram").join(weights, "gram").groupBy("url").agg(F.round(F.avg("weight"), 9).alias("score"))
    scored = stored(urls.join(summed, "url"), "url-scores")
    place = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(MOST_BIN)), F.lit(-MOST_BIN))
    bins = scored.where("calibrates AND ruled IS NOT NULL").groupBy(place.alias("bin")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("no"),
    )
    limit = threshold([tuple(r) for r in bins.collect()])  # at most 2 * MOST_BIN + 1 rows
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    verdicts = scored.select("url", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
    return rows.join(verdicts, "url").select("id", "host", "path", "rule", "verdict", "score")
