"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8, app: str = "siltstone") -> SparkSession:
    """A ``local[n]`` session with UTC, AQE and no UI."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they were started.

    A local session's workers get its folder on their path; a cluster's executors are sent an archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_shipped", False):
        return
    sc._siltstone_shipped = True
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = f"{root}{os.pathsep}{known}" if known else root
        return
    folder = tempfile.mkdtemp(prefix="siltstone-")
    archive = os.path.join(folder, "siltstone_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(top, f), os.path.relpath(os.path.join(top, f), root))
    sc.addPyFile(archive)
