"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "segtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and results independent of the host's time zone.

    The shuffle width is only a starting point: adaptive execution merges small
    partitions and splits skewed ones, so a cluster passes a generous number and
    a laptop its core count. Python call sites are not recorded for each column,
    which would take longer than small queries run; errors still name the column.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
