"""WARC archives: written by the text sink, read back by boundary-chain verification.

A record ends with two line breaks, so the text sink with that separator writes archives byte for
byte. They are read in splits: the text source cuts at the magic ``WARC/1.``, wherever it stands.
What follows a cut is a *candidate*: a record, or magic inside a payload. Its header gives the
offset of its successor. Offsets in a file follow from the lengths of the parts in a split and the
lengths of the splits before. Only candidates that are reached from the start of the file, from
successor to successor, are records. The chain is walked inside every split first, and pointer
jumping joins up the splits: every pass doubles the number of splits that a pointer crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwitness.llm.common import Steps, stored, whole_text
from fleetwitness.session import scratch_path

# The forms of the standard.
MAGIC = "WARC/1."
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are kept once.
REVISIT_BYTES = 100
#: So many repeated payloads (digest and id) are broadcast; more are joined by shuffle.
FEW_COPIES = 100_000
STAMP = "2000-01-01T00:00:00Z"


def _name_of(id: Column) -> Column:
    """A record's URI from the row's id; a null id has its own."""
    return F.when(id.isNull(), "urn:x-row:none").otherwise(F.concat(F.lit("urn:x-row:id:"), F.url_encode(id.cast("string"))))


def _id_of(name: Column) -> Column:
    return F.when(name.startswith("urn:x-row:id:"), F.url_decode(F.substring(name, 14, 1 << 30)))


def first_copies(pages: DataFrame, html: str, id: str, least: int) -> DataFrame:
    """Digests of payloads that several rows share, with the smallest id of each."""
    body = whole_text(html).cast("binary")
    seen = pages.select(F.col(id).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    shared = seen.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return shared.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")


def write_archive(
    pages: DataFrame,
    folder: str,
    html: str = "html",
    id: str = "page_id",
    url: str = "url",
    least: int = REVISIT_BYTES,
    max_records: int = 0,
) -> None:
    """Write a record per row below ``folder``, one file per task (``max_records`` cuts files).

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest id are written
    as ``response``, the others as ``revisit`` of it without the payload; rows with a null id
    revisit if another row has an id, and are responses if none has. A null payload is empty. A
    null url has no target line; line breaks in it are percent-encoded. Repeated rows are records
    of their own. Columns other than the three named are not read, whatever their names. An empty
    table writes an empty folder.
    """
    steps = Steps(pages.sparkSession)
    copies = steps.keep(first_copies(pages, html, id, least), "copies")
    if copies.count() <= FEW_COPIES:
        copies = F.broadcast(copies)
    body = whole_text(html).cast("binary")
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest")
    ).join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length("body").cast("string")), F.lit("\r\n"),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("body"))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Date", F.lit(STAMP)),
        line("WARC-Record-ID", F.concat(F.lit("<"), _name_of(F.col("id")), F.lit(">"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), _name_of(F.col("first")), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("body").cast("string")))
    writer = rows.select(record.alias("value")).write.option("lineSep", END)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.text(folder)
    steps.drop("copies")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each magic up to the next: ``file, split, at, body``; ``at`` grows inside a split."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_bytes"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").cast("binary").alias("body"),
        )
    )


def _header(name: str) -> Column:
    """A header line of a candidate, by name in any case; null where absent."""
    return F.nullif(F.regexp_extract("head", rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _part(start: Column, length: Column | None = None) -> Column:
    """Bytes of the body from ``start`` (0-based) on."""
    return F.substring("body", (start + 1).cast("int"), (F.lit(1 << 30) if length is None else length).cast("int"))


def candidates(spark: SparkSession, folder: str, steps: Steps) -> DataFrame:
    """Every magic of the archives with its header and the offset of its successor.

    A payload that lies in the candidate's own part is hashed here, where it is read.
    """
    magic = len(MAGIC)
    raw = _chunks(spark, folder)
    bytes_ = F.octet_length("body")
    head = F.substring_index(F.col("body").cast("string"), END, 1)
    # Latin-1 keeps lengths: one character per byte.
    parsed = raw.withColumn("head", head).withColumn("head_bytes", F.octet_length("head"))
    size = _header("Content-Length").cast("bigint")
    whole = F.col("body").cast("string").startswith("1\r\n") | F.col("body").cast("string").startswith("0\r\n")
    kind = _header("WARC-Type")
    plausible = whole & size.isNotNull() & (size >= 0) & kind.isNotNull() & (F.col("head_bytes") + 4 <= bytes_)
    block = F.col("head_bytes") + 4
    # From the magic's first byte to the next record's.
    span = F.lit(magic) + block + size + len(END)
    own = plausible & (block + size + len(END) <= bytes_)
    content = _part(block, size)
    http_head = F.octet_length(F.substring_index(content.cast("string"), END, 1)) + len(END)
    is_http = F.lower(_header("Content-Type")).startswith("application/http")
    skip = F.when(is_http, http_head).otherwise(0)
    payload_bytes = F.when(
        kind == "revisit", F.regexp_extract(content.cast("string"), r"(?i)\nContent-Length:[ \t]*(\d+)", 1).try_cast("bigint")
    ).otherwise(F.greatest(size - skip, F.lit(0)))
    table = parsed.select(
        "file", "file_bytes", "split", "at", (bytes_ + magic).cast("bigint").alias("bytes"),
        F.when(plausible, span.cast("bigint")).alias("span"), F.when(plausible, own).alias("own"),
        F.when(plausible, kind).alias("type"),
        F.when(plausible, F.regexp_replace(_header("WARC-Record-ID"), "^<|>$", "")).alias("record_id"),
        F.when(plausible, F.regexp_replace(_header("WARC-Refers-To"), "^<|>$", "")).alias("refers_to"),
        F.when(plausible, _header("WARC-Target-URI")).alias("uri"),
        F.when(plausible, F.regexp_replace(F.lower(_header("WARC-Payload-Digest")), "^sha256:", "")).alias("declared"),
        F.when(own, payload_bytes).alias("payload_bytes"),
        F.when(own & (kind != "revisit"), F.sha2(_part(block + skip, F.greatest(size - skip, F.lit(0))), 256)).alias("digest"),
        F.sha2("body", 256).alias("chunk"),
    )
    kept = steps.keep(table, "chunks")
    # The text before the first magic of a file is a part too; a split's parts add up to the split.
    order = Window.partitionBy("file", "split").orderBy("at")
    inside = kept.withColumn("after", F.sum("bytes").over(order)).withColumn("nth", F.row_number().over(order))
    totals = kept.groupBy("file", "split").agg(F.sum("bytes").alias("split_bytes"))
    base = totals.withColumn("base", F.sum("split_bytes").over(Window.partitionBy("file").orderBy("split")) - F.col("split_bytes"))
    placed = inside.join(base, ["file", "split"])
    # A part starts behind its magic, whose bytes were counted with the part before.
    start = F.col("base") + F.col("after") - F.col("bytes") - magic
    return placed.select(
        "*",
        start.alias("offset"),
        (start + F.col("span")).alias("next"),
        (F.col("base") - magic).alias("split_start"),
        (F.col("base") + F.col("split_bytes") - magic).alias("split_end"),
    ).drop("after", "nth", "base", "split_bytes")


def _leave(table: pa.Table) -> pa.Table:
    """Where the chain from each candidate leaves the split: an offset, or null where it breaks."""
    rows = sorted(zip(table["offset"].to_pylist(), table["next"].to_pylist(), strict=True), reverse=True)
    end = table["split_end"][0].as_py()
    out: dict[int, int | None] = {}
    for offset, follows in rows:
        out[offset] = follows if follows >= end else out.get(follows)
    return pa.table(
        {"file": [table["file"][0].as_py()] * len(out), "offset": pa.array(list(out), pa.int64()), "leave": pa.array(list(out.values()), pa.int64())}
    )


def _walk(key: tuple[pa.Scalar, ...], table: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of a split that are reached from its entries."""
    follows = dict(zip(table["offset"].to_pylist(), table["next"].to_pylist(), strict=True))
    found: set[int] = set()
    for at in entries["offset"].to_pylist():
        while at in follows and at not in found:
            found.add(at)
            at = follows[at]
    return pa.table({"file": pa.array([key[0].as_py()] * len(found), pa.string()), "offset": pa.array(sorted(found), pa.int64())})


def reachable(found: DataFrame, steps: Steps) -> DataFrame:
    """``file, offset`` of the candidates that are reached from the start of their file.

    A split's candidates are chained by one task; a split has a bounded number of bytes. The
    passes work on entries only, of which an intact file has one per split.
    """
    nodes = steps.keep(
        found.where("next IS NOT NULL AND next <= file_bytes").select("file", "split", "offset", "next", "split_end"), "nodes"
    )
    leaves = steps.keep(nodes.groupBy("file", "split").applyInArrow(_leave, "file string, offset bigint, leave bigint"), "leaves")
    targets = leaves.where("leave IS NOT NULL").select("file", F.col("leave").alias("offset")).distinct()
    starts = leaves.where("offset = 0").select("file", "offset")
    jump = steps.keep(leaves.where("offset > 0").join(targets, ["file", "offset"], "left_semi").unionByName(leaves.where("offset = 0")), "jump0")
    reached = steps.keep(starts, "reached0")
    count, passes = reached.count(), 0
    while True:
        # Entries reached so far also reach what is 2^passes splits behind them.
        more = reached.join(jump, ["file", "offset"]).where("leave IS NOT NULL").select("file", F.col("leave").alias("offset"))
        passes += 1
        now = steps.keep(reached.unionByName(more.join(jump.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), f"reached{passes}")
        reached, grown = now, now.count()
        if grown == count:
            break
        count = grown
        ahead = jump.select("file", F.col("offset").alias("leave"), F.col("leave").alias("then"))
        farther = jump.join(ahead, ["file", "leave"], "left").select("file", "offset", F.col("then").alias("leave"))
        # A pointer that has run out of the file crosses nothing, but its entry stays known.
        jump = steps.keep(farther, f"jump{passes}")
    ends = nodes.select("file", "split", "offset")
    entered = steps.keep(reached.join(ends, ["file", "offset"]).select("file", "split", "offset"), "entered")
    walked = (
        nodes.select("file", "split", "offset", "next")
        .groupBy("file", "split")
        .cogroup(entered.groupBy("file", "split"))
        .applyInArrow(_walk, "file string, offset bigint")
    )
    return steps.keep(walked, "walked")


def _members(records: DataFrame, found: DataFrame) -> DataFrame:
    """The parts that hold the bytes of each record: ``file, offset, part, split, chunk``."""
    spans = records.select("file", "offset", "next")
    parts = found.select("file", F.col("offset").alias("part"), (F.col("offset") + F.col("bytes")).alias("part_end"), "split", "chunk")
    # Records don't overlap, so the latest record that starts at or before a part holds it.
    marks = spans.select("file", F.col("offset").alias("pos"), F.lit(0).alias("side"), F.struct("offset", "next").alias("own"), F.lit(None).cast(parts.select(F.struct("part", "split", "chunk")).schema[0].dataType).alias("p"))
    rows = parts.select("file", F.col("part").alias("pos"), F.lit(1).alias("side"), F.lit(None).cast("struct<offset:bigint,next:bigint>").alias("own"), F.struct("part", "split", "chunk").alias("p"))
    line = Window.partitionBy("file").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.unionByName(rows).withColumn("own", F.last("own", ignorenulls=True).over(line)).where("side = 1 AND own.next > p.part")
    return held.select("file", F.col("own.offset").alias("offset"), "p.part", "p.split", "p.chunk")


def record_bytes(spark: SparkSession, folder: str, records: DataFrame, found: DataFrame) -> DataFrame:
    """``file, offset, block``: the block (what the header's length counts) of the given records.

    The archives are read once more; of each split the parts of the records asked for are taken by
    their digest, and put together by record. One record's bytes are one row.
    """
    members = _members(records, found)
    wanted = members.select("file", "split", "chunk").distinct()
    bodies = _chunks(spark, folder).withColumn("chunk", F.sha2("body", 256)).join(wanted, ["file", "split", "chunk"])
    # Equal parts of a split are equal bytes; one is enough.
    bodies = bodies.groupBy("file", "split", "chunk").agg(F.first("body").alias("body"))
    pieces = members.join(bodies, ["file", "split", "chunk"])
    # The magic between two parts belongs to the payload.
    joined = pieces.groupBy("file", "offset").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col("body").cast("string").alias("text")))), lambda p: p["text"]), MAGIC).alias("text")
    )
    sized = joined.join(records.select("file", "offset", "next"), ["file", "offset"])
    body = F.col("text").cast("binary")
    head = F.octet_length(F.substring_index("text", END, 1)) + len(END)
    size = F.col("next") - F.col("offset") - len(MAGIC) - head - len(END)
    return sized.select("file", "offset", F.substring(body, (head + 1).cast("int"), size.cast("int")).alias("block"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives below ``folder``, one row each: ``file, offset, type, record_id,
    uri, refers_to, declared, payload_bytes, digest``.

    ``digest`` is the SHA-256 of the payload as read, for a revisit the declared one; a payload is
    the block without its HTTP header. Magic inside a payload is no record, whatever header follows
    it. Where a chain breaks (a successor that is no candidate, a record beyond the end of the file)
    the records before it are returned. A folder without files or records gives no rows.
    """
    steps = Steps(spark)
    found = steps.keep(candidates(spark, folder, steps), "candidates")
    kept = reachable(found, steps)
    records = found.join(kept, ["file", "offset"])
    names = ["file", "offset", "type", "record_id", "uri", "refers_to", "declared", "payload_bytes"]
    digest = F.when(F.col("type") == "revisit", F.col("declared")).otherwise(F.col("digest")).alias("digest")
    whole = records.where("own").select(*names, digest)
    spread = steps.keep(records.where("NOT own").select(*names, "next"), "spread")
    if spread.isEmpty():
        return whole
    block = F.col("block").cast("string")
    skip = F.octet_length(F.substring_index(block, END, 1)) + len(END)
    payload = F.when(block.startswith("HTTP/"), F.substring("block", skip + 1, F.lit(1 << 30))).otherwise(F.col("block"))
    put = record_bytes(spark, folder, spread, found).withColumn("payload", payload)
    put = put.select("file", "offset", F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("sum"))
    filled = spread.drop("payload_bytes", "next").join(put, ["file", "offset"]).select(
        *names[:-1], F.col("size").alias("payload_bytes"), F.when(F.col("type") == "revisit", F.col("declared")).otherwise(F.col("sum")).alias("digest")
    )
    return whole.unionByName(filled)


def archive_round_trip(pages: DataFrame, html: str = "html", id: str = "page_id", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages, read the archives back: ``id, payload_bytes, digest, type, refers_to``.

    One row per page; see ``write_archive`` and ``read_archive`` for odd rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "archive")
    write_archive(pages, folder, html, id, url, least)
    kind = pages.schema[id].dataType
    return stored(
        read_archive(spark, folder).select(
            _id_of(F.col("record_id")).cast(kind).alias("id"), "payload_bytes", "digest", "type", _id_of(F.col("refers_to")).cast(kind).alias("refers_to")
        ),
        "records",
    )
