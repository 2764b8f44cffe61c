"""Names and small texts in the file system that a path belongs to, through Spark's own Hadoop client."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder; none if it does not exist."""
    where, system = _path(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(where)] if system.exists(where) else []


def partition_values(spark: SparkSession, root: str, keys: list[str]) -> list[tuple[str, ...]]:
    """Values of the partition folders ``key=value/..`` under ``root``, from their names alone."""
    where, system = _path(spark, root)
    if not system.exists(where):
        return []
    pattern = spark._jvm.org.apache.hadoop.fs.Path(where, "/".join(f"{k}=*" for k in keys))
    paths = [status.getPath().toUri().getPath() for status in system.globStatus(pattern)]
    return [tuple(unquote(part.split("=", 1)[1]) for part in path.split("/")[-len(keys) :]) for path in paths]


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, system = _path(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file a new name unless that is taken; False if it is."""
    where, system = _path(spark, target)
    system.mkdirs(where.getParent())
    files = spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(files.Options.Rename, 0)
    try:
        context.rename(files.Path(source), where, options)
    except Exception as error:  # noqa: BLE001
        if "FileAlreadyExists" in str(error) or system.exists(where):
            return False
        raise
    return True
