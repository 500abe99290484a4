"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What the operators rely on; cluster sizing is left to the submitter.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: str | None = None


def get_session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared folder in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder: on a
    cluster a machine-local folder would be invisible to the other executors.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="sluice-")
        base = _local_scratch
    return f"{base.rstrip('/')}/sluice/{purpose}-{uuid.uuid4().hex[:12]}"


def mounted_path(path: str) -> str:
    """``path`` as a plain file-system path; raises for object stores, which Python tasks cannot open."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path or path.split("/", 1)[0].endswith(":"):
        raise ValueError(f"a mounted folder is needed, got {path}")
    return path
