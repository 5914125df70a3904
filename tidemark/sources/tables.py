"""Base tables, named views and written feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from tidemark.specs import Study


class LazyTables(Mapping):
    """Tables that are opened on first use, so that a query reads the file
    listings and footers of its own sources only."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._makers[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def load_tables(
    spark: SparkSession,
    folder: str,
    names: Sequence[str] | Mapping[str, str],
    source: str = "parquet",
    schemas: Mapping[str, T.StructType | str] | None = None,
    **options: str,
) -> LazyTables:
    """Tables below ``folder``: one file or folder per name.

    ``names`` may map a table name to another file name.  Text formats take a
    schema per table, so that no pass over the data infers one.
    """
    files = names if isinstance(names, Mapping) else {name: name for name in names}

    def opener(name: str, file: str) -> Callable[[], DataFrame]:
        def open_table() -> DataFrame:
            reader = spark.read.format(source).options(**options)
            if schemas and name in schemas:
                reader = reader.schema(schemas[name])
            return reader.load(f"{folder.rstrip('/')}/{file}.{source}")

        return open_table

    return LazyTables({name: opener(name, file) for name, file in files.items()})


def load_jdbc(spark: SparkSession, names: Mapping[str, str], **options: str) -> LazyTables:
    """Tables from a database; pass ``partitionColumn`` and bounds to read in parallel."""
    reader = spark.read.format("jdbc").options(**options)
    return LazyTables({name: lambda t=table: reader.option("dbtable", t).load() for name, table in names.items()})


def define_views(tables: Mapping[str, DataFrame]) -> None:
    """Replaceable lazy views; nothing is computed or stored."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def materialize(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> DataFrame:
    """Drop-and-create a Parquet table and read it back.

    ``sort_by`` sorts inside each file so that row groups can be skipped.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Drop-and-create a bucketed table: later joins on ``key`` need no shuffle.

    Rows are moved to their buckets first, so that each is one sorted file.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def stay_vitals_schema(study: Study) -> T.StructType:
    """Declared schema of the stay-vitals table."""
    fields = [
        T.StructField(study.entity, T.LongType()),
        T.StructField("stay_id", T.LongType()),
        T.StructField("intime", T.TimestampNTZType()),
    ]
    fields += [T.StructField(c, T.DoubleType()) for c in study.vitals.value_columns]
    fields += [T.StructField(c, T.IntegerType()) for c in study.vitals.missing_columns]
    return T.StructType(fields)


def typed_empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that later stages fill by ``unionByName``."""
    return spark.createDataFrame([], schema)


def load_features_with_split(features: DataFrame, split: DataFrame, entity: str) -> DataFrame:
    """Feature rows that have a split label, with that label."""
    return features.join(split.select(entity, "split"), entity)


def load_split_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
