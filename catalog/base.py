"""Registration of queries and their oracle texts, and the tables several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.oracle import oracle_text
from variantloom import fixtures
from variantloom.session import path_exists, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The fixture views of one data folder, plus the stage outputs derived from them.

    A derived table is written once per application and folder, as the stages of the offline
    flow hand their output on, and read back by every later query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.TABLES:
            return self._table(name)
        if name in fixtures.VIEWS:
            return self.stored(name, lambda: fixtures.view(self.spark, name, lambda source: getattr(self, source)))
        raise AttributeError(name)

    def _table(self, name: str) -> DataFrame:
        """A test table is one row group, hence one task; larger input has its own parallelism."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def stored(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = self.stored_path(label)
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def stored_path(self, label: str) -> str:
        slug = self.sf_dir.strip("/").replace("/", "_")
        return f"{shared_dir(self.spark)}/stage/{slug}/{label}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison; -0.0 becomes 0.0."""

    def show(field) -> Column:
        c = F.col(f"`{field.name}`")
        if field.dataType.simpleString() != "double":
            return c
        return (F.round(c, digits) + F.lit(0.0)).alias(field.name)

    return df.select(*[show(f) for f in df.schema])


def real(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable whole numbers as doubles, which both engines hand to pandas alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
