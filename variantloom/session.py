"""Session settings and the shared work folder."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = threading.local()


def build_session(app_name: str = "variantloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Sizes (shuffle partitions, memory) stay with the caller: they depend on the cluster.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # the JVM never compiles a method over 8000 bytes; past that, per-operator code is faster
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session may go without the setting; its tables then lie beside the warehouse.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
    return f"{base.rstrip('/')}/variantloom-{sc.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true size of the
    table, so that a join against it is broadcast only when it really is small.
    """
    path = fresh_path(df.sparkSession, label)
    for made in getattr(_SCRATCH, "open", []):
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted(spark: SparkSession) -> Iterator[list[str]]:
    """Paths of the tables that ``materialize`` writes inside, in this thread."""
    made: list[str] = []
    _SCRATCH.open = [*getattr(_SCRATCH, "open", []), made]
    try:
        yield made
    finally:
        _SCRATCH.open = [m for m in _SCRATCH.open if m is not made]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``materialize`` writes inside (in this thread) are deleted at the end.

    For work whose result is stored before the end; a lazy result that still reads them would lose its input.
    """
    with noted(spark) as made:
        try:
            yield made
        finally:
            delete_tables(spark, made)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Work that is started inside gives Python at most ``most`` rows at once, where the session has no smaller limit.

    A batch is held by the JVM and by the Python worker of each running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_tables(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, without hidden ones."""
    fs, target = hadoop_path(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def fingerprint(spark: SparkSession, paths: Sequence[str], *options: object) -> str:
    """Digest of names, sizes and modification times of files and folders, and of options."""
    seen = [repr(o) for o in options]
    for path in sorted(paths):
        fs, target = hadoop_path(spark, path)
        for status in fs.globStatus(target) or []:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            files = [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in inside if not s.getPath().getName().startswith(("_", "."))]
            seen += [repr(f) for f in sorted(files)]
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()
