"""Session construction with settings that suit both a laptop and a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "ledgerloom", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Return a session with adaptive execution, UTC timestamps and Arrow transfer; `extra` overrides."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf |= {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
