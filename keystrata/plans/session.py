"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, name: str = "keystrata", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the deployment's own settings hold instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{n}]",
        "spark.app.name": name,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.config(map=settings | conf).getOrCreate()
