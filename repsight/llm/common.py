"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repsight.plans.session import ensure_checkpoint_dir

#: White space of the word contracts: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package where they could not import it by themselves."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_repsight_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="repsight-ship-"), "repsight.zip")  # on the driver; Spark's file server hands it out
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.glob("repsight/**/*.py")):
            z.write(f, f.relative_to(root))
    sys_path = list(sys.path)
    spark.sparkContext.addPyFile(str(path))
    sys.path[:] = sys_path  # the driver keeps its own copy
    spark.sparkContext._repsight_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    The folder outlives a lost executor and is seen by every machine; only a
    local session without the setting falls back to a temporary folder.
    """
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array (null text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), without keeping them: each word and the space after it become one character.

    regexp_count would make an array of all words first, several times the text's memory.
    """
    marks = F.regexp_replace(F.ltrim(text, F.lit(SPACES)), WORD + r"[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")
