"""Live forms of the batch operators (R1–R9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetwitness.functions.scalars import micros, whole_number
from fleetwitness.operators.logs import captured
from fleetwitness.operators.ordered import small_side
from fleetwitness.sources.logs import parse_log_line
from fleetwitness.sources.sinks import append_digest
from fleetwitness.streaming.keyed import AnchoredHits, Confirmed, InOrder, Owners, OwnersUntil, Runs, Twins

CMD_SIDE, REPORT_SIDE = 0, 1
OPEN, LINE, READ = range(3)


def tail_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """R1: parsed lines of rolled log files as they appear.

    The file source takes whole files, so a partial last line is never seen: writers roll a file
    when it is complete. Files that still grow are read by ``sources.tail``.
    """
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
    return parse_log_line(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def catalogue_rows(expectations: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """One row per scenario: its lines (``exps``), its forbidden specs (``forbs``) and both as ``plan``.

    A scenario's lines are a page of a catalogue, so one row holds them.
    """
    named = set(expectations.columns)
    kind = F.col("kind") if "kind" in named else F.lit("log")
    line = F.struct("i", "tokens", "same_line", "need", "extract", "min_value", "within_s", kind.alias("kind"))
    rows = expectations.groupBy("scenario").agg(F.sort_array(F.collect_list(line)).alias("exps"))
    if forbidden is None:
        rows = rows.withColumn("forbs", F.array().cast("array<struct<j:int,token:string,after_token:string>>"))
    else:
        specs = forbidden.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("j", "token", "after_token"))).alias("forbs"))
        rows = rows.join(specs, "scenario", "left")

    def naming(f: Column) -> Column:
        lines = F.filter("exps", lambda e: F.coalesce(F.array_contains(e["tokens"], f["after_token"]), F.lit(False)))
        return F.when(f["after_token"].isNotNull(), F.transform(lines, lambda e: e["i"]))

    lines = F.transform("exps", lambda e: F.struct(e["i"].alias("i"), e["need"].alias("need"), e["within_s"].alias("within_s"), e["kind"].alias("kind")))
    specs = F.transform(
        F.coalesce("forbs", F.array()), lambda f: F.struct(f["j"].alias("j"), f["token"].alias("token"), naming(f).alias("anchors"))
    )
    return rows.withColumn("plan", F.to_json(F.struct(lines.alias("lines"), specs.alias("forbidden"))))


def tag_lines(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lines (scenario, text, …) with what they meet, in one pass and without reading the catalogue
    at the driver: ``hits`` (i, reaches) and ``bad`` (j), and the ``plan`` of the scenario."""
    text = F.col("text")
    has = lambda t: F.coalesce(F.contains(text, t), F.lit(False))

    def reaches(e: Column) -> Column:
        value = captured(text, e["extract"])
        number = e["min_value"].isNull() | (whole_number(value) >= e["min_value"])
        return e["extract"].isNull() | F.coalesce(value.isNotNull() & number, F.lit(False))

    met = F.filter(
        "exps",
        lambda e: F.coalesce(F.exists(e["tokens"], has), F.lit(False))
        & F.coalesce(F.forall(F.coalesce(e["same_line"], F.array().cast("array<string>")), has), F.lit(True)),
    )
    bad = F.filter(F.coalesce("forbs", F.array()), lambda f: has(f["token"]))
    return lines.join(small_side(catalogue), "scenario").withColumns(
        {
            "hits": F.transform(met, lambda e: F.struct(e["i"].alias("i"), reaches(e).alias("reaches"))),
            "bad": F.transform(bad, lambda f: f["j"]),
        }
    ).drop("exps", "forbs")


#: Keys are dealt into so many buckets; a checkpoint holds them, so the number stays.
BUCKETS = 2048


def _keyed(rows: DataFrame, processor: InOrder, out: str | StructType, event_time: str = "") -> DataFrame:
    bucket = F.pmod(F.xxhash64(*processor.keys), F.lit(BUCKETS)).cast("int")
    buckets = rows.withColumn("_bucket", bucket).groupBy("_bucket")
    return buckets.transformWithState(processor, out, "append", "eventTime", eventTimeColumnName=event_time)


def _fields(rows: DataFrame, *names: str) -> StructType:
    return StructType([rows.schema[n] for n in names])


def stream_forbidden(lines: DataFrame, runs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """R2: alert on a forbidden token at first sight.

    ``runs`` (run_id, scenario) and ``forbidden`` are static tables; no state is kept and nothing is
    collected. Specs with ``after_token`` need their anchor: see ``stream_anchored``.
    """
    specs = forbidden.where("after_token IS NULL").groupBy("scenario").agg(F.collect_list(F.struct("j", "token")).alias("_specs"))
    rules = runs.select("run_id", "scenario").join(small_side(specs), "scenario")
    found = F.filter("_specs", lambda f: F.coalesce(F.contains(F.col("text"), f["token"]), F.lit(False)))
    hits = lines.join(rules, "run_id").withColumn("_hit", F.explode(found))
    return hits.select(*lines.columns, "scenario", F.col("_hit.j").alias("j"), F.col("_hit.token").alias("token"))


def stream_anchored(
    lines: DataFrame, expectations: DataFrame, forbidden: DataFrame, delay: str, keep: str = "1 day"
) -> DataFrame:
    """R2 with ``after_token``: forbidden lines below the line that satisfies their anchor.

    ``lines``: run_id, scenario, ts, idx, text. Anchors are found in the same stream: the first line
    that completes an expectation naming the token. Lines may come out of order within ``delay``; a
    run is forgotten when nothing of it was seen for ``keep`` of event time. Every hit is a row:
    run_id, j, token, idx.
    """
    catalogue = catalogue_rows(expectations, forbidden.where("after_token IS NOT NULL"))
    tagged = tag_lines(lines.withWatermark("ts", delay).where("ts IS NOT NULL"), catalogue)
    rows = tagged.where((F.size("hits") > 0) | (F.size("bad") > 0)).select(
        "run_id", "ts", micros(F.col("ts")).alias("us"), F.col("idx").cast("bigint").alias("seq"), "plan",
        F.to_json(F.struct("hits", "bad")).alias("what"),
    )
    kind = rows.schema["run_id"].dataType.simpleString()
    processor = AnchoredHits(_fields(rows, "run_id", "us", "seq", "plan", "what"), ["run_id"], _interval_us(lines, keep))
    return _keyed(rows, processor, f"run_id {kind}, j int, token string, idx bigint")


def _interval_us(df: DataFrame, interval: str) -> int:
    """An interval in microseconds, as Spark reads it."""
    at = df.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{interval}') AS us")
    return int(at.first()["us"])


def stream_verdicts(
    lines: DataFrame,
    expectations: DataFrame,
    delay: str,
    forbidden: DataFrame | None = None,
    reads: DataFrame | None = None,
    grace_s: float = 0.0,
    keep: str = "1 day",
) -> DataFrame:
    """R3: the verdict of every run as soon as it is certain, over log, API and forbidden lines.

    ``lines``: run_id, scenario, t0, ts, idx, text (NULL text opens a run without counting); with
    ``reads``: run_id, scenario, t0, ts, poll_seq, i, state (see ``read_states``). State and timers
    are keyed by run: a timer waits for the deadline of the line that is due, and when the watermark
    has passed it the run fails without another line. Rows may come out of order within ``delay``.
    A verdict does not depend on how the rows are cut into micro-batches. It is that of the batch
    ``adjudicate`` with file order in the order of time; ``last_idx`` is the last line that counted
    before the verdict. A decided run is remembered for ``keep``. A run that a forbidden line fails is
    told at once with ``revision`` 0; where an earlier line proves forbidden when its anchor's turn
    comes, a row with the next ``revision`` takes its place (see ``last_revisions``).
    """
    catalogue = catalogue_rows(expectations, forbidden)
    tagged = tag_lines(lines.withWatermark("ts", delay).where("ts IS NOT NULL"), catalogue)
    counts = (F.size("hits") > 0) | (F.size("bad") > 0)
    rows = tagged.select(
        "run_id", "scenario", "ts", micros(F.col("ts")).alias("us"), micros(F.col("t0")).alias("t0_us"), "plan",
        F.when(counts, LINE).otherwise(OPEN).alias("side"), F.col("idx").cast("bigint").alias("seq"),
        F.when(counts, F.to_json(F.struct("hits", "bad"))).alias("what"),
    )
    if reads is not None:
        plans = small_side(catalogue.select("scenario", "plan"))
        polled = reads.withWatermark("ts", delay).where("ts IS NOT NULL").join(plans, "scenario").select(
            "run_id", "scenario", "ts", micros(F.col("ts")).alias("us"), micros(F.col("t0")).alias("t0_us"), "plan",
            F.lit(READ).alias("side"), F.col("poll_seq").cast("bigint").alias("seq"),
            F.to_json(F.struct("i", "state")).alias("what"),
        )
        rows = rows.unionByName(polled)
    kind = rows.schema["run_id"].dataType.simpleString()
    fields = _fields(rows, "run_id", "scenario", "us", "t0_us", "plan", "side", "seq", "what")
    out = f"run_id {kind}, scenario string, status string, reason string, failed_i int, forbidden_idx bigint, last_idx bigint, decided_after_us bigint, revision int"
    return _keyed(rows, Runs(fields, ["run_id"], int(grace_s * 1_000_000), _interval_us(lines, keep)), out)


def last_revisions(verdicts: DataFrame) -> DataFrame:
    """Of every run the verdict with the highest ``revision``; for a table that the stream has written."""
    own = [c for c in verdicts.columns if c not in ("run_id", "revision")]
    return verdicts.groupBy("run_id").agg(F.max_by(F.struct(*own), "revision").alias("_last")).select("run_id", "_last.*")


def stream_confirm(cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str], delay: str | None = None) -> DataFrame:
    """R4: one verdict per command as soon as the watermark has passed what decides it.

    That is the agreeing report, the newer command, or the end of its timeout; a command that cannot
    be confirmed, or has no profile row, is told at once. Per attribute one open command is kept, and
    its rows of one delay. Streams that have a watermark already are given without ``delay``.
    """
    if delay is not None:
        cmds, reports = cmds.withWatermark("ts", delay), reports.withWatermark("ts", delay)
    terms = profile.select("capability", "confirmability", "mode", F.col("tolerance").cast("double"), "unit", (F.col("timeout_ms") * 1000).alias("timeout_us"))
    a = cmds.join(small_side(terms), "capability", "left").select(
        *keys, "ts", F.lit(CMD_SIDE).alias("side"), F.col("cmd_id").alias("id"), F.col("target").cast("double").alias("value"),
        "capability", "confirmability", "mode", "tolerance", "unit", "timeout_us",
    )
    none = [F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ("capability", "confirmability", "mode", "tolerance", "unit", "timeout_us")]
    b = reports.select(*keys, "ts", F.lit(REPORT_SIDE).alias("side"), F.col("report_id").alias("id"), F.col("value").cast("double"), *none)
    rows = a.unionByName(b).where("ts IS NOT NULL").withColumn("us", micros(F.col("ts")))
    fields = _fields(rows, *keys, "us", "side", "id", "value", "capability", "confirmability", "mode", "tolerance", "unit", "timeout_us")
    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = f"cmd_id bigint, {own}, us bigint, capability string, verdict string, latency_us bigint, confirmed_by bigint"
    verdicts = _keyed(rows, Confirmed(fields, keys), out)
    return verdicts.select("cmd_id", *keys, F.timestamp_micros("us").alias("ts"), "capability", "verdict", "latency_us", "confirmed_by")


def _owned(cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str], delay: str | None) -> tuple[DataFrame, Owners]:
    if delay is not None:
        cmds, reports = cmds.withWatermark("ts", delay), reports.withWatermark("ts", delay)
    timed = cmds.join(small_side(profile.select("capability", "timeout_ms")), "capability", "left")
    a = timed.select(*keys, "ts", F.lit(CMD_SIDE).alias("side"), F.col("cmd_id").alias("id"), (F.col("timeout_ms") * 1000).alias("timeout_us"))
    b = reports.select(*keys, "ts", F.lit(REPORT_SIDE).alias("side"), F.col("report_id").alias("id"), F.lit(None).cast("bigint").alias("timeout_us"))
    rows = a.unionByName(b).where("ts IS NOT NULL").withColumn("us", micros(F.col("ts")))
    return rows, Owners(_fields(rows, *keys, "us", "side", "id", "timeout_us"), keys)


OWNED = "cmd_id bigint, cmd_us bigint, timeout_us bigint, report_id bigint, after_us bigint"


def late_reports(cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str], delay: str | None = None) -> DataFrame:
    """R8: every report with its command, and whether it came after the deadline.

    A late report is evidence of its own: it tells a slow device from one without an edge. A report
    is judged when the watermark has passed it, for only then no command between can come any more.
    Per attribute the newest command is kept, which owns what comes next, however late.
    """
    rows, processor = _owned(cmds, reports, profile, keys, delay)
    owned = _keyed(rows, processor, OWNED).where("report_id IS NOT NULL AND timeout_us IS NOT NULL")
    return owned.select("cmd_id", "report_id", "after_us", (F.col("after_us") > F.col("timeout_us")).alias("late"))


def command_outcomes(
    cmds: DataFrame, reports: DataFrame, profile: DataFrame, keys: Sequence[str], horizon: str, delay: str | None = None
) -> DataFrame:
    """R8 per command: reported in time, late, or without an edge, when ``horizon`` has passed.

    Two stateful operators: the owner of each report by attribute, and behind it an aggregation by
    command that closes when the watermark passes the command's horizon. Its event time is that
    instant, which no report inside the horizon comes after. Reports beyond it are left to
    ``late_reports``.
    """
    rows, processor = _owned(cmds, reports, profile, keys, delay)
    processor = OwnersUntil(processor.fields, keys, _interval_us(cmds, horizon))
    owned = _keyed(rows, processor, f"{OWNED}, closes_at timestamp", "closes_at").where("timeout_us IS NOT NULL")
    per = owned.groupBy("closes_at", "cmd_id").agg(
        F.count("report_id").alias("n_reports"), F.min("after_us").alias("first_after_us"), F.max("timeout_us").alias("timeout_us")
    )
    outcome = F.when(F.col("n_reports") == 0, "no_edge").when(F.col("first_after_us") > F.col("timeout_us"), "late").otherwise("in_time")
    return per.select("cmd_id", outcome.alias("outcome"), "n_reports", "first_after_us")


def stream_drop_twins(events: DataFrame, keys: Sequence[str], order: Sequence[str], max_gap_s: float, delay: str) -> DataFrame:
    """R5: reports without their twins, for any order of arrival within ``delay``.

    ``events``: keys, ts, tsn, value and more; ``order`` sorts the reports of a key and starts with
    ``ts``. A key's state is its reports of one delay, in a list, and the last report judged, which is
    forgotten when the gap has passed. The result is that of ``drop_twins`` on what the watermark has
    passed.
    """
    stamps = [f.name for f in events.schema.fields if f.dataType.typeName() == "timestamp" and f.name != "ts"]
    rows = events.withWatermark("ts", delay).where("ts IS NOT NULL").withColumns({"us": micros(F.col("ts")), **{s: micros(F.col(s)) for s in stamps}})
    names = ["us", *[c for c in events.columns if c != "ts"]]
    processor = Twins(_fields(rows, *names), keys, ["us", *[o for o in order if o != "ts"]], int(max_gap_s * 1_000_000))
    out = _keyed(rows, processor, _fields(rows, *names))
    back = {"ts": F.timestamp_micros("us"), **{s: F.timestamp_micros(s) for s in stamps}}
    return out.withColumns(back).select(*events.columns)


def stream_sessions(events: DataFrame, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """R6: bursts of a stream, closed by a pause of ``gap``."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def stream_tumbling(events: DataFrame, keys: Sequence[str], size: str, delay: str) -> DataFrame:
    """R7: counts per window and key, emitted when the watermark closes the window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("start"), "n")
    )


def digest_sink(folder: str):
    """R9: ``foreachBatch`` function that appends each night once, also when replayed."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_digest(batch, folder)

    return write
