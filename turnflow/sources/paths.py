"""Path checks on whatever file system the path names."""

from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(location)


def files_under(spark: SparkSession, path: str) -> list[str]:
    """The file at `path`, or the files of that folder in order of their names, without hidden ones."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(location)
    paths = sorted(str(f.getPath()) for f in found if f.isFile())
    return [p for p in paths if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
