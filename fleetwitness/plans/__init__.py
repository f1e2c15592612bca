"""Registered queries over the driver's tables."""

from fleetwitness.plans import (  # noqa: F401
    command_queries,
    corpus_queries,
    liveness_queries,
    log_queries,
    scalar_queries,
    sensor_queries,
    source_queries,
    stream_queries,
    suite_queries,
)
from fleetwitness.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
