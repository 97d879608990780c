"""Session defaults and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "zonaria", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments override them (dots as ``__``)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (local runs)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="zonaria-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder and reads it back.

    The lineage is cut, the files outlive executors, and their size is known to
    the optimiser, so a later join is broadcast only when the rows really are
    few.  The files go when the enclosing ``scratch`` block ends, else with the
    application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/zonaria-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if _blocks:
        _blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_blocks: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose written tables are deleted at its end.

    For a long session that runs query after query: make the query and use up
    its result inside, as what it returns still reads those tables.
    """
    _blocks.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _blocks.pop():
            p = hadoop.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="zonaria-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
