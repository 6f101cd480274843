"""Cutting lineage so that loops stay cheap and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session whose executors all live on this machine gets a folder of its own,
    which goes when the process ends; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tesselon-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and read it from there.

    The files live as long as something may read them: with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` the session deletes those
    that nothing refers to any more.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
