"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on one machine, as in tests."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hopweave-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set(KEY, root)
    return root


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and read again: cuts the lineage of a loop and survives lost executors."""
    return counted(df, name)[0]


def counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """``stored``, and the number of rows as the same job saw it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
