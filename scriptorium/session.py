"""The shared folder, table snapshots and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (spark.checkpoint.dir). Where it is unset, one of this machine if Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="scriptorium-")
        shared_dir.own = where
    return where


#: What `stored` has written within each `scratch` that is open here.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that `stored` wrote within it, but kept ones. Plans that read the others are of no use then:
    store their results within it, with keep."""
    made: list[str] = []
    token = _made.set((*_made.get(), made))
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors. keep: no `scratch` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made.get() if not keep else ():
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once per context, so that they need no install."""
    sc = spark.sparkContext
    if getattr(ship, "sent", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="scriptorium-code-"), "scriptorium_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("scriptorium") / p.relative_to(root))
    sc.addPyFile(at)
    ship.sent = sc.applicationId
