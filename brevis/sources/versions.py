"""Tables that are replaced as a whole: every version is a folder of its own, and readers take the last committed one.

A version counts once its marker exists, and the marker is made after its last file. A write that fails, before or after
files have been written, leaves the version before it in place. Folders and markers go through the file system that Spark uses for
the path, so a store that only Spark reads will do.
"""

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"  # names that begin with an underscore are no data to Spark's readers
KEPT = 2  # versions that stay: the last one, and the one that readers may still hold


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and a maker of its path objects."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def committed(spark: SparkSession, path: str) -> list:
    """Numbers of the committed versions, ascending."""
    files, make = _files(spark, path)
    folder = make(f"{path}/{COMMITS}")
    if not files.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())


def commit(spark: SparkSession, path: str, number: int) -> None:
    files, make = _files(spark, path)
    files.create(make(f"{path}/{COMMITS}/{number}"), True).close()


def write_version(df: DataFrame, path: str, number: int, keep: int | None = KEPT) -> None:
    """Write version ``number`` of the table and commit it; a repeated number replaces that version.

    Versions older than the last ``keep`` are removed afterwards (none without it).
    """
    spark = df.sparkSession
    files, make = _files(spark, path)
    files.delete(make(f"{path}/{COMMITS}/{number}"), False)  # no longer whole from here on
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    commit(spark, path, number)
    if keep:
        for old in committed(spark, path)[:-keep]:
            files.delete(make(f"{path}/{COMMITS}/{old}"), False)
            files.delete(make(f"{path}/version={old}"), True)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The last committed version."""
    found = committed(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.parquet(f"{path}/version={found[-1]}")


def read_every_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed versions, with their number as ``version``."""
    found = committed(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={n}" for n in found])
