"""Session defaults. A cluster's own settings always win over these."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "gridsight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a fixed UTC clock.

    On a cluster leave ``master`` unset and pass nothing: partition counts, memory
    and the checkpoint folder come from the cluster's own configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Recording a Python call site for every column expression doubles the time
        # it takes to build wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """Session for tests and the bench on one machine."""
    cpus = cpus or os.cpu_count() or 4
    return build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("GRIDSIGHT_DRIVER_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            **conf,
        },
    )
