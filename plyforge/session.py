"""Session settings shared by the command line, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "plyforge", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings win where they are given.

    master and shuffle_partitions are for local runs; on a cluster spark-submit names the master and adaptive
    execution sizes the shuffle.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master or not os.environ.get("MASTER"):
        builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
