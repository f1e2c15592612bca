"""Device-bench analytics on Spark: logs, commands, sensors and suites to verdicts."""

__version__ = "0.1.0"
