"""Where jobs may put tables, checkpoints and stream state.

The folder is the one the cluster names in ``spark.checkpoint.dir``, so every
executor sees it. Only a local session without that setting gets a folder of
its own, which is what tests use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from gaugeworks.errors import ConfigError


#: The folders made for local sessions, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder reachable from the driver and all executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="gaugeworks-")
        return _OWN[application]
    raise ConfigError("set spark.checkpoint.dir to a folder shared by all executors")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/gaugeworks/{label}-{uuid.uuid4().hex}"
