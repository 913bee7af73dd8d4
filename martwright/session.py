"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates come from timestamps in some sources; month and day must not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits partitions that one key makes oversized, in the joins laid out for it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash join instead of sort-merge where AQE has measured every partition of the build
    # side to be small. Most build sides have one row per key; where keys repeat (pairs,
    # order matching) the measured size counts them all. The threshold is compressed map
    # output, of which the hash table takes several times, once per running task.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
    # Recording the Python call site of every column expression costs more driver time
    # than planning does; set it back to true for error messages with call sites.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Sums of money must fail on overflow rather than wrap.
    "spark.sql.ansi.enabled": "true",
}


def builder(app: str = "martwright") -> SparkSession.Builder:
    """A builder with the settings above; master and sizes are left to spark-submit."""
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b
