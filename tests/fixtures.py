"""Small inputs with recorded answers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pyspark.sql.types as T
from pyspark.sql import functions as F


def at(day: str, clock: str) -> datetime:
    return datetime.fromisoformat(f"{day}T{clock}")


def table(spark, ddl, rows):
    return spark.createDataFrame(rows, T.StructType.fromDDL(ddl))


# A recorded motion walk test (UTC-4 wall clock, sequence number, occupancy).
WALK = [
    ("21:45:02.066", 41, 0), ("21:45:32.820", 42, 1), ("21:45:32.830", 43, 1), ("21:46:36.146", 45, 0),
    ("21:46:36.155", 46, 0), ("21:48:01.081", 47, 1), ("21:48:01.090", 48, 1), ("21:49:00.160", 50, 0),
    ("21:49:00.169", 51, 0), ("21:49:45.861", 52, 1), ("21:49:45.875", 53, 1), ("21:50:44.790", 55, 0),
    ("21:50:44.798", 56, 0), ("21:51:00.821", 57, 1), ("21:51:00.832", 58, 1), ("21:51:59.810", 60, 0),
    ("21:51:59.818", 61, 0), ("21:53:00.689", 62, 1), ("21:53:00.696", 63, 1), ("21:54:05.979", 65, 0),
    ("21:54:05.988", 66, 0), ("21:54:25.071", 67, 1), ("21:54:25.082", 68, 1), ("21:57:01.357", 70, 0),
    ("21:57:01.373", 71, 0), ("21:58:00.803", 72, 1), ("21:58:00.811", 73, 1), ("21:58:59.814", 75, 0),
    ("21:58:59.822", 76, 0), ("21:59:00.980", 77, 1), ("21:59:00.987", 78, 1), ("22:00:58.955", 80, 0),
    ("22:00:58.963", 81, 0), ("22:01:00.288", 82, 1), ("22:01:00.309", 83, 1),
]
WAVES = ["21:48:00", "21:51:00", "21:53:00", "21:58:00", "21:59:00", "22:01:00"]


def walk_events(spark):
    ddl = "device_id STRING, cluster STRING, attr_name STRING, ts TIMESTAMP, tsn INT, value INT"
    return table(spark, ddl, [("pir", "0x0406", "occupancy", at("2026-07-01", c), n, v) for c, n, v in WALK])


def walk_stimuli(spark):
    rows = [("pir", i, at("2026-07-01", w), True) for i, w in enumerate(WAVES)] + [("pir", 99, None, False)]
    return table(spark, "device_id STRING, stimulus_id BIGINT, ts TIMESTAMP, timed BOOLEAN", rows)


# Commands, reports and acknowledgements of one lamp, whose verdicts were recorded.
DAY = "2026-07-01"
COMMANDS = [
    (1, "20:04:35.113", "current_level", "0x0008", "brightness", 128.0),
    (2, "20:23:12.011", "color_temperature", "0x0300", "color_temperature", 447.0),
    (3, "20:23:39.573", "color_temperature", "0x0300", "color_temperature", 161.0),
    (4, "20:23:40.069", "color_temperature", "0x0300", "color_temperature", 216.0),
    (5, "20:23:40.575", "color_temperature", "0x0300", "color_temperature", 221.0),
    (6, "20:35:30.895", "identify", "0x0003", "identify", 5.0),
    (7, "20:40:00.000", "color_temperature", "0x0300", "color_temperature", 153.0),
    (8, "20:50:00.000", "current_level", "0x0008", "brightness", 128.0),
    (9, "20:51:00.000", "current_level", "0x0008", "brightness", 10.0),
]
REPORTS = [
    (1, "20:04:35.641", "current_level", "0x0008", 128.0),
    (2, "20:23:18.669", "color_temperature", "0x0300", 447.0),
    (3, "20:23:48.999", "color_temperature", "0x0300", 221.0),
    (4, "20:40:08.875", "color_temperature", "0x0300", 154.0),
]
ACKS = [
    (1, "20:04:35.204", "0x0008", "SUCCESS"), (2, "20:23:12.102", "0x0300", "SUCCESS"),
    (3, "20:35:30.986", "0x0003", "SUCCESS"), (4, "20:50:00.090", "0x0008", "SUCCESS"),
    (5, "20:51:00.090", "0x0008", "FAILURE"),
]


def lamp(spark):
    cmds = table(
        spark,
        "cmd_id BIGINT, ts TIMESTAMP, attr_name STRING, cluster STRING, capability STRING, target DOUBLE",
        [(i, at(DAY, c), *rest) for i, c, *rest in COMMANDS],
    ).withColumn("device_id", F.lit("lamp"))
    reports = table(
        spark,
        "report_id BIGINT, ts TIMESTAMP, attr_name STRING, cluster STRING, value DOUBLE",
        [(i, at(DAY, c), *rest) for i, c, *rest in REPORTS],
    ).withColumn("device_id", F.lit("lamp"))
    acks = table(
        spark, "ack_id BIGINT, ts TIMESTAMP, cluster STRING, status STRING", [(i, at(DAY, c), *rest) for i, c, *rest in ACKS]
    ).withColumn("device_id", F.lit("lamp"))
    profile = table(
        spark,
        "capability STRING, mode STRING, tolerance DOUBLE, unit STRING, confirmability STRING, timeout_ms BIGINT",
        [
            ("brightness", "TOLERANCE", 0.0, "raw", "CONFIRMABLE", 5000),
            ("color_temperature", "TOLERANCE", 50.0, "kelvin", "CONFIRMABLE", 15000),
            ("identify", "DISABLED", 0.0, "raw", "UNCONFIRMABLE", 5000),
        ],
    )
    return cmds, reports, acks, profile


# The line form and the tokens of a boot log. Devices, ports and clocks are made up;
# relinks after the second carry a four-digit stamp.
def boot_text(relinks: int, proposed: bool = False) -> list[str]:
    def line(clock, who, message):
        return f"{clock} [main] INFO bench.{who} -- {message}"

    out = [
        line("00:21:48.900", "Main", "starting"),
        line("00:21:51.439", "Registry", "registry.projection_live: devices=6 entities=6 position=25065"),
    ]
    for n in range(relinks):
        clock = f"00:21:51.99{n}" if n < 2 else f"00:21:51.10{n:02d}"
        out.append(line(clock, "Adoption", f"zigbee.device_relinked: device=0x{n} deviceId=D{n} — re-pairing"))
    if proposed:
        out.append(line("00:21:52.500", "Adoption", "zigbee.device_proposed: device=0x9 status=COMPLETE"))
    return out + [
        line("00:21:52.026", "Adapter", "zigbee.adoption_maps_rehydrated: devices=6"),
        line("00:21:59.687", "Adapter", "zigbee.port_identity_captured: vendorId=10c4 pinnedOnly=false"),
        line("00:21:59.802", "Adapter", "zigbee.network_resumed: channel=20 panId=0x774c"),
        line("00:21:59.803", "Ezsp", "zigbee.network_up: up (buffered)"),
        line("00:22:03.914", "Tracker", "zigbee.availability_changed: device=0x3 available=true"),
    ]


RESEAT_OK = ["transport_failed: gone", "port_unhealthy: cause=read-error", "reopen_no_target: retry",
             "reopen_no_target: retry", "reopened: port=/dev/x", "availability_changed: up"]
RESEAT_FLAP = ["transport_failed: gone", "port_unhealthy: cause=read-error", "reopen_no_target: retry",
               "reopened: port=/dev/x", "reopen_no_target: retry"]


def reseat(messages):
    return [f"09:02:{11 + n}.101 [z-0] WARN bench.Adapter -- zigbee.{m}" for n, m in enumerate(messages)]


def log_rows(spark, logs: dict[str, list[str]]):
    start = datetime(2026, 7, 31)
    rows = [(r, i, start + timedelta(seconds=i), text) for r, lines in logs.items() for i, text in enumerate(lines)]
    return table(spark, "run_id STRING, idx BIGINT, observed_at TIMESTAMP, text STRING", rows)


EXPECTATION = (
    "scenario STRING, i INT, tokens ARRAY<STRING>, same_line ARRAY<STRING>, need INT, extract STRING, min_value BIGINT, within_s INT"
)


def boot_catalogue(spark, within=90):
    return table(
        spark,
        EXPECTATION,
        [
            ("boot", 0, ["registry.projection_live: devices=6 entities=6"], [], 1, r"position=(\d+)", 25065, within),
            ("boot", 1, ["zigbee.adoption_maps_rehydrated: devices=6"], [], 1, None, None, within),
            ("boot", 2, ["zigbee.device_relinked"], [], 2, None, None, within),
            ("boot", 3, ["zigbee.network_resumed: channel=20 panId=0x774c"], [], 1, None, None, within),
            ("boot", 4, ["zigbee.port_identity_captured:"], ["pinnedOnly=false"], 1, None, None, within),
        ],
    )


def boot_forbidden(spark):
    return table(
        spark,
        "scenario STRING, j INT, token STRING, after_token STRING",
        [("boot", 0, "device_proposed", None), ("boot", 1, "network_parameter_mismatch", None)],
    )
