"""What a session shares: the package on Python workers, the folder that all machines see, and tables written there."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("made", default=())


def ship(spark: SparkSession) -> None:
    """Add this package's sources to the application once; executors fetch them from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="findoc-")) / "findoc_package.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, str(Path(here.name) / path.relative_to(here)))
    context.addPyFile(str(bundle))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; before and after it they are as the session had them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="findoc-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession) -> str:
    """A new folder's path that all machines share; those of one application are together."""
    return f"{shared_dir(spark)}/findoc/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_per_batch: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The write's shuffle files go once it has ended. ``rows_per_batch`` bounds the Arrow batches of the write.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    for made in _made.get():
        made.append(path)
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if rows_per_batch:
        held["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows_per_batch)
    with settings(spark, held):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned; nothing may read them, or a frame made from them, from now on."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete(table.sparkSession, path)


@contextlib.contextmanager
def releasing(spark: SparkSession, keep: tuple[DataFrame, ...] | list[DataFrame] = ()) -> Iterator[None]:
    """Delete at the end of the block every table that it wrote, other than those of ``keep`` (a list may grow inside)."""
    made: list[str] = []
    token = _made.set((*_made.get(), made))
    try:
        yield
    finally:
        _made.reset(token)
        kept = {_paths.get(t) for t in keep}
        delete(spark, *(p for p in made if p not in kept))
