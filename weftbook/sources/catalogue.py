"""Reading and writing the catalogue's own tables under their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import broken_row_counts
from ..schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; the declared schema is used, nothing is inferred.

    A table written by ``write_table`` is partitioned by status, so a filter on
    status reads only those folders.
    """
    return spark.read.schema(TABLES[name].struct()).parquet(f"{root}/{name}")


class StoredCatalogue:
    """All stored tables below one folder, opened on first use: ``StoredCatalogue(spark, root).jobs``.

    What asks several tables at once (front page, search, site map, counts, relations) takes such an object.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        frame = read_table(self.spark, self.root, name)
        setattr(self, name, frame)
        return frame


def read_catalogue(spark: SparkSession, root: str) -> StoredCatalogue:
    return StoredCatalogue(spark, root)


def write_catalogue(tables, root: str) -> None:
    """Store every declared table of an object that has them as attributes."""
    for name in TABLES:
        write_table(getattr(tables, name), root, name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    ids: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table of the site's own database.

    With ``ids`` (lowest and highest id) it is read in ``partitions`` slices side by
    side.  Filters and column choices reach the database.
    """
    reader = spark.read.format("jdbc").options(url=database_url(url), dbtable=name, **options)
    if ids:
        reader = reader.options(
            partitionColumn="id", lowerBound=str(ids[0]), upperBound=str(ids[1]), numPartitions=str(partitions)
        )
    return conform(reader.load(), name)


def database_url(url: str) -> str:
    """A JDBC address from the forms ``postgres://`` and ``postgresql://``."""
    for prefix in ("postgres://", "postgresql://"):
        if url.startswith(prefix):
            return "jdbc:postgresql://" + url[len(prefix):]
    return url


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in the declared types; columns a batch lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].struct()
        ]
    )


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Store a table in its declared columns: by status where it has one, else in plain files."""
    df = conform(df, name)
    writer: DataFrameWriter = df.write.mode(mode)
    if "status" in df.columns:
        writer = writer.partitionBy("status")
    writer.parquet(f"{root}/{name}")


def write_checked(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> DataFrame:
    """``write_table`` with a report of the rows just written, taken while they pass: no second reading.

    table_name, rule (not null, length or domain; ``rows`` for their number), column_name and n, one row per broken rule and one
    for ``rows``.  The rows are stored whether they break a rule or not.  Columns the batch lacks are stored as NULL and count so.
    """
    df, seen = conform(df, name), Observation()
    write_table(df.observe(seen, *broken_row_counts(TABLES[name], set(df.columns))), root, name, mode)
    found = [(name, *key.split(":"), n) for key, n in seen.get.items() if n or key == "rows:"]
    rows = [(table, rule, column or None, n) for table, rule, column, n in found]
    return df.sparkSession.createDataFrame(rows, "table_name string, rule string, column_name string, n bigint")
