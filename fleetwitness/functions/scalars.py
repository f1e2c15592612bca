"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names and their short tags.
STATUS_TAGS = {
    "PASS": "PASS",
    "FAIL": "FAIL",
    "SKIPPED": "SKIP",
    "REFUSED": "REFUSED",
    "DEFERRED": "DEFER",
}


def iso_instant(text: Column) -> Column:
    """ISO instant to a UTC timestamp, NULL when it does not parse; no zone means UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "z$", "Z"))


def duration_seconds(text: Column) -> Column:
    """``"<N>s"`` to seconds, NULL for any other form."""
    return F.regexp_extract(F.trim(text), r"^(\d+)s$", 1).try_cast("int")


def seconds_text(seconds: Column) -> Column:
    """Latency as text: two decimals below ten seconds, one from there on."""
    exact = seconds.cast("decimal(20,6)")
    two = F.concat(F.round(exact, 2).cast("decimal(20,2)").cast("string"), F.lit("s"))
    one = F.concat(F.round(exact, 1).cast("decimal(20,1)").cast("string"), F.lit("s"))
    return F.when(exact < 0, F.lit("n/a(negative-latency)")).when(exact < 10, two).otherwise(one)


def whole_number(text: Column) -> Column:
    """Integer value of a text, NULL when it is not an integer."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))


def time_of_day_ms(line: Column) -> Column:
    """Milliseconds since midnight from a leading ``HH:MM:SS.mmm`` stamp, else NULL.

    Four-digit milliseconds are not a stamp.
    """
    def number(start: int, length: int) -> Column:
        return F.substring(line, start, length).try_cast("int")

    seconds = (number(1, 2) * 60 + number(4, 2)) * 60 + number(7, 2)
    return F.when(line.rlike(r"^\d{2}:\d{2}:\d{2}\.\d{3}\s"), seconds * 1000 + number(10, 3))


def hex_to_int(text: Column) -> Column:
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]+$"), F.conv(digits, 16, 10).cast("bigint"))


def int_to_hex(number: Column, width: int = 4) -> Column:
    """Upper-case hex with a ``0x`` prefix, padded to ``width`` digits and never cut."""
    digits = F.hex(number.cast("bigint"))
    padded = F.lpad(digits, width, "0")
    return F.concat(F.lit("0x"), F.when(F.length(digits) >= width, digits).otherwise(padded))


def mired_to_kelvin(mired: Column) -> Column:
    return F.when(mired != 0, F.lit(1e6) / mired)


def level_to_percent(level: Column) -> Column:
    """0..254 device level to whole percent."""
    return F.round(level * 100 / F.lit(254.0)).cast("int")


def percent_to_level(percent: Column) -> Column:
    """Whole percent to 0..254 device level."""
    return F.round(percent * F.lit(254.0) / 100).cast("int")


def battery_percent(raw: Column) -> Column:
    """Half-percent units to percent."""
    return raw / F.lit(2.0)


def battery_millivolts(raw: Column) -> Column:
    """Hundred-millivolt units to millivolts."""
    return raw * 100


def eui64_text(octets: Column) -> Column:
    """Little-endian 8-byte address to colon-separated text."""
    return F.concat_ws(
        ":", F.transform(F.reverse(octets), lambda b: F.lpad(F.lower(F.hex(b.cast("bigint"))), 2, "0"))
    )


def flag(mask: Column, bit: int) -> Column:
    """True when ``bit`` is set."""
    return F.getbit(mask.cast("bigint"), F.lit(bit)) == 1


# Fixed value: a reason names capabilities in square brackets.
CAPABILITY = r"\[([^\]]+)\]"


def capability_group(reason: Column) -> Column:
    """Names in square brackets joined with ``+``; ``?`` when the reason names none."""
    names = F.regexp_extract_all(reason, F.lit(CAPABILITY), F.lit(1))
    return F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(F.lit("?"))


def status_tag(status: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in STATUS_TAGS.items() for x in pair])
    return F.element_at(tags, status)


def verdict_line(status: Column, name: Column, reason: Column) -> Column:
    """``[TAG] name — reason``; the dash is left out when there is no reason."""
    tail = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" — "), reason)).otherwise(F.lit(""))
    return F.concat(F.lit("["), status_tag(status), F.lit("] "), name, tail)


def local_to_utc(wall_clock: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall_clock, zone)


def message_token(message: Column) -> Column:
    """Message text before the first ``:``; NULL when there is none."""
    return F.nullif(F.regexp_extract(message, r"^\s*([^\s:]+):", 1), F.lit(""))


def message_pairs(message: Column) -> Column:
    """``key=value`` pairs of a message as a map; the first value of a repeated key is kept."""
    pairs = F.regexp_extract_all(message, F.lit(r"([A-Za-z][A-Za-z0-9_.-]*=[^\s;,]+)"), F.lit(1))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("value")
        ),
    )
    firsts = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda f: f["key"] == e["key"]),
    )
    return F.map_from_entries(firsts)


def json_at(body: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a VARIANT; NULL when a segment is missing or not an object."""
    return F.try_variant_get(body, "$." + path, kind)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    return micros(end) - micros(start)
