"""Catalogue checks: expectation rules, parameter binding, required settings."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwitness.functions.scalars import duration_seconds
from fleetwitness.operators.ordered import small_side

# Closed vocabularies of the catalogue.
TOP_KEYS = (
    "scenario", "tier", "requires", "preconditions", "let", "stimulus", "evidence", "verdict",
)
API_ASSERTS = (
    "rows", "ulids", "new_confirmed_run", "new_run_after", "phase_terminal", "field_equals",
)
STIMULUS_KEYS = ("bench", "api", "usb", "plug", "operator")
BINDING_FORMS = ("api", "other_of")
APP_STATES = ("running", "fresh-boot", "any")
REFERENCE = r"\$\{(?:C|let)\.[A-Za-z0-9_.\-]+\}"


def unknown_keys(keys: Column, allowed: Sequence[str]) -> Column:
    """Used keys outside the allowed set, sorted."""
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))


def _broken(df: DataFrame, section: int, line: Column, *tests: tuple[str, Column, Column]) -> DataFrame:
    """One row per broken rule; all tests of a section read their rows once."""
    found = [
        F.when(
            test,
            F.struct(F.lit(rule).alias("rule"), F.lit(int(rule[1:])).alias("rule_no"), detail.cast("string").alias("detail")),
        )
        for rule, test, detail in tests
    ]
    rows = df.select(
        "scenario",
        F.lit(section).alias("section"),
        line.cast("int").alias("line"),
        F.explode(F.array_compact(F.array(*found))).alias("_b"),
    )
    return rows.select("scenario", "_b.rule", "section", "line", "_b.rule_no", "_b.detail")


def validate_expectations(
    scenarios: DataFrame,
    positives: DataFrame,
    forbidden: DataFrame,
    stimuli: DataFrame | None = None,
    bindings: DataFrame | None = None,
) -> DataFrame:
    """One row per broken rule of the catalogue, L1 to L17.

    scenarios: scenario, file_stem, tier, keys[], requires_is_list, precondition, uses_exactly
    positives: scenario, i, kinds[], log, log_any[], count, has_extract, has_min, within,
               assert_keys[], anchor
    forbidden: scenario, j, token, after_token
    stimuli:   scenario, i, kinds[] · bindings: scenario, i, forms[]
    """
    zero, none = F.lit(0), F.lit(None)
    s, p = scenarios, positives
    is_log = F.col("log").isNotNull()
    is_any = F.array_contains("kinds", "log_any")
    is_api = F.array_contains("kinds", "api")
    unknown = unknown_keys(F.col("keys"), TOP_KEYS)
    unknown_asserts = unknown_keys(F.col("assert_keys"), API_ASSERTS)
    bad_api = (F.coalesce(F.size("assert_keys"), zero) <= 0) | (F.size(unknown_asserts) > 0)
    empty = s.join(p.select("scenario").distinct(), "scenario", "left_anti")
    out = [
        _broken(
            s, 0, zero,
            ("L1", F.col("scenario") != F.col("file_stem"), F.col("file_stem")),
            ("L2", F.size(unknown) > 0, F.array_join(unknown, ",")),
            ("L3", ~F.coalesce(F.col("tier").isin("AUTO", "OPERATOR"), F.lit(False)), F.col("tier")),
            ("L4", ~F.col("requires_is_list"), none),
            ("L5", F.col("uses_exactly"), none),
            ("L6", ~F.coalesce("precondition", F.lit("any")).isin(*APP_STATES), F.col("precondition")),
        ),
        _broken(empty, 1, zero, ("L7", F.lit(True), none)),
        _broken(
            p, 2, F.col("i"),
            ("L8", F.size("kinds") != 1, F.array_join("kinds", ",")),
            ("L9", duration_seconds(F.col("within")).isNull(), F.col("within")),
            ("L10", is_any & (F.coalesce(F.size("log_any"), zero) <= 0), none),
            ("L11", F.col("count").isNotNull() & (F.col("count") < 1), F.col("count")),
            ("L12", F.col("has_min") & ~F.col("has_extract"), none),
            ("L13", is_api & bad_api, F.array_join(unknown_asserts, ",")),
        ),
    ]
    # L14: the anchor is a plain token of an earlier line of the same scenario.
    anchored = p.where(F.array_contains("assert_keys", "new_run_after")).select("scenario", "i", "anchor")
    first = p.where(is_log).groupBy("scenario", F.col("log").alias("anchor")).agg(F.min("i").alias("_first"))
    unmet = ~F.coalesce(F.col("_first") < F.col("i"), F.lit(False))
    placed = anchored.join(first, ["scenario", "anchor"], "left")
    out.append(_broken(placed, 2, F.col("i"), ("L14", unmet, F.col("anchor"))))
    both = p.groupBy("scenario").agg(
        F.max(F.array_contains("assert_keys", "new_run_after")).alias("_a"),
        F.max(F.array_contains("assert_keys", "new_confirmed_run")).alias("_b"),
    )
    out.append(_broken(both, 3, zero, ("L15", F.col("_a") & F.col("_b"), none)))
    tokens = p.select("scenario", F.explode(F.concat(
        F.when(is_log, F.array("log")).otherwise(F.array().cast("array<string>")),
        F.coalesce("log_any", F.array().cast("array<string>")),
    )).alias("after_token")).distinct()
    scoped = forbidden.where(F.col("after_token").isNotNull())
    unnamed = scoped.join(tokens, ["scenario", "after_token"], "left_anti")
    out.append(_broken(unnamed, 4, F.col("j"), ("L16", F.lit(True), F.col("after_token"))))
    for shapes, column, allowed, section in ((stimuli, "kinds", STIMULUS_KEYS, 5), (bindings, "forms", BINDING_FORMS, 6)):
        if shapes is not None:
            known = F.array_intersect(column, F.array(*[F.lit(a) for a in allowed]))
            wrong = (F.size(known) != 1) | (F.size(column) != 1)
            out.append(_broken(shapes, section, F.col("i"), ("L17", wrong, F.array_join(column, ","))))
    return functools.reduce(DataFrame.unionByName, out)


def first_refusal(broken: DataFrame) -> DataFrame:
    """The rule a scenario is refused for: by section, then line, then rule."""
    return broken.groupBy("scenario").agg(
        F.min_by("rule", F.struct("section", "line", "rule_no")).alias("rule"), F.count(F.lit(1)).alias("broken")
    )


def bind_parameters(texts: DataFrame, constants: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Replace every ``${C.path}`` / ``${let.name}`` of a text.

    ``constants``: ref (the whole reference text), value, value_type. A text that is
    one reference keeps the native type of the value. A missing constant refuses
    the row; a missing let stays unbound.
    """
    refs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({REFERENCE})"), F.lit(1)))
    found = texts.select(*keys, F.col(text).alias("_text"), F.explode_outer(refs).alias("ref"))
    rows = found.join(small_side(constants), "ref", "left")
    pair = F.struct("ref", F.col("value").alias("val"))
    # A text has a handful of distinct references; the list is bounded by the text itself.
    grouped = rows.groupBy(*keys, "_text").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), pair))).alias("_refs"),
        F.max(F.col("ref").startswith("${C.") & F.col("value").isNull()).alias("_missing"),
        F.max(F.when(F.col("ref") == F.col("_text"), F.col("value_type"))).alias("_whole"),
    )
    bound = F.aggregate("_refs", F.col("_text"), lambda acc, r: F.replace(acc, r["ref"], r["val"]))
    return grouped.select(
        *keys,
        F.col("_text").alias(text),
        bound.alias("bound"),
        F.coalesce("_whole", F.lit("STRING")).alias("value_type"),
        F.coalesce("_missing", F.lit(False)).alias("refused"),
    )


def find_unset(required: DataFrame, constants: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Required settings that are missing, blank, a placeholder, or not a duration where one is due.

    ``required``: path, is_duration; ``constants``: path, value.
    """
    rows = required.join(constants.select(*on, "value"), list(on), "left")
    value = F.col("value")
    unset = value.isNull() | (F.trim(value) == "") | F.contains(value, F.lit("PLACEHOLDER"))
    wrong = F.col("is_duration") & ~F.trim(value).rlike(r"^\d+[smhd]?$")
    problem = F.when(unset, "unset").when(wrong, "not a duration")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull())


def branch_problems(required: DataFrame, constants: DataFrame, branch_path: str, branches: Sequence[str], key: str = "config_id") -> DataFrame:
    """Problems of many configurations, each with the settings that its own branch requires.

    ``required``: path, is_duration, branch (NULL: in every branch); ``constants``: key, path, value.
    The value at ``branch_path`` must be one of ``branches``, as it stands; else that is a problem of
    its own, and only what every branch requires is looked for. A configuration is known by any of
    its rows. Required settings are a page, so a configuration's rows are as many.
    """
    chosen = constants.groupBy(key).agg(F.max(F.when(F.col("path") == branch_path, F.col("value"))).alias("chosen"))
    known = F.coalesce(F.col("chosen").isin(*branches), F.lit(False))
    # One row holds the page; a configuration takes its settings out of it.
    page = required.groupBy().agg(F.collect_list(F.struct("path", "is_duration", "branch")).alias("page"))
    mine = F.filter("page", lambda r: r["branch"].isNull() | (known & (r["branch"] == F.col("chosen"))))
    wanted = chosen.join(F.broadcast(page)).select(key, F.explode(mine).alias("r")).select(key, "r.path", "r.is_duration")
    found = find_unset(wanted, constants, (key, "path")).select(key, "path", "problem")
    wrong = chosen.where(~known).select(key, F.lit(branch_path).alias("path"), F.lit("not a branch").alias("problem"))
    return found.where(F.col("path") != branch_path).unionByName(wrong)
