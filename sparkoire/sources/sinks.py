"""Writers."""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

PARTITIONS = ("participant_label", "specimen_label")


def partitioned(df: DataFrame, path: str, by: tuple[str, ...] = PARTITIONS) -> None:
    """Parquet by partition columns; rows of a partition are gathered first, so that each makes one file unless it is large."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def tsv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def fasta(df: DataFrame, path: str, name: str, number: str, sequence: str) -> None:
    """Records named name|number; blank sequences are left out."""
    kept = df.where(F.trim(F.coalesce(F.col(sequence), F.lit(""))) != "")
    kept.select(F.concat(F.lit(">"), F.concat_ws("|", F.col(name), F.col(number).cast("string")), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def airr(df: DataFrame, columns: dict[str, str], empty: dict[str, DataType]) -> DataFrame:
    """Selected, renamed columns with typed nulls behind them."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()], *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])


def by_participant(df: DataFrame, path: str) -> None:
    df.repartition("participant_label").write.mode("overwrite").option("sep", "\t").option("header", True).partitionBy("participant_label").csv(path)


def shared_records(df: DataFrame, block: list[str], sequence: str, ids: Column) -> DataFrame:
    """One record for each distinct sequence of a block, its ids joined by commas in order."""
    return df.groupBy(*block, sequence).agg(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), ",").alias("ids"))


def jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    """Rows appended to a table, which is made where it is missing."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def embedded(df: DataFrame, place: str, table: str, **options: str) -> None:
    """Rows loaded into a new table of an embedded database in a mounted folder.

    One process alone may have such a database open: the driver makes it and takes
    in the files that executors write, one by one, by the database's own bulk load.
    A field is quoted, or empty where it is null; numbers, text, dates, times and flags can be loaded.
    """
    url, files = f"jdbc:derby:{place};create=true", f"{place}-rows"
    quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(",", *quoted).alias("value")).write.text(files)
    jdbc(df.where("false"), url, table, **options)
    connection = df.sparkSession.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        load.setString(1, table.upper())
        for file in sorted(Path(files).glob("part-*")):
            load.setString(2, str(file))
            load.execute()
    finally:
        connection.close()
    shutil.rmtree(files)


def packed_database(spark: SparkSession, place: str) -> str:
    """URL of a read-only copy of the embedded database in a mounted folder, for any number of processes at once.

    The database is shut down and its files, stored as they are, become one archive in its place.
    """
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{place};shutdown=true")
    except Py4JJavaError as closed:
        if closed.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(f"{place}.jar", "w", zipfile.ZIP_STORED) as out:
        for file in sorted(Path(place).rglob("*")):
            if file.is_file() and not file.name.endswith(".lck"):
                out.write(file, Path("db", file.relative_to(place)))
    shutil.rmtree(place)
    return f"jdbc:derby:jar:({place}.jar)db"


def embeddings(df: DataFrame, path: str, by: tuple[str, ...] = ("fold_id", "fold_label")) -> None:
    """Vectors with their metadata as Parquet, a folder for each fold and label."""
    partitioned(df, path, by)


def transforms(model, path: str) -> None:
    """A fitted scaling or projection, to be read back by ``PipelineModel.load``."""
    model.write().overwrite().save(path)
