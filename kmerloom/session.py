"""Session helpers: shipping this package to executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ResourceError

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return spark
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = os.path.join(tempfile.mkdtemp(), "kmerloom_pkg.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
    return spark


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a local session may lack that setting; it then gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ResourceError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        top = _own[app]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: no lineage, and its size is known."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
