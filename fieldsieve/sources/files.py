"""What files there are, and the beginnings of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldsieve.functions.text import base_name


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, project) of all files under a folder, project being the first folder below it. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    below = F.split(F.element_at(F.split(F.col("path"), folder.rstrip("/").replace("file://", "") + "/", 2), -1), "/")
    return files.select("path", base_name(F.col("path")).alias("file_name"), F.when(F.size(below) > 1, below[0]).alias("project"))


def existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of the folders that exist, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [(f, jvm.org.apache.hadoop.fs.Path(f)) for f in folders]
    return [f for f, p in paths if p.getFileSystem(conf).exists(p) and p.getFileSystem(conf).getFileStatus(p).isDirectory()]


def preview(spark: SparkSession, path: str, lines: int = 10) -> tuple[list[str], int]:
    """The first lines of a text file, and how many more there are."""
    text = spark.read.text(path)
    return [r["value"] for r in text.limit(lines).collect()], max(0, text.count() - lines)


def excerpt(lines: list[str], start: str, end: str) -> list[str]:
    """The lines between two marks."""
    a = next(i for i, x in enumerate(lines) if start in x)
    return lines[a + 1 : next(i for i, x in enumerate(lines) if i > a and end in x)]


def write_text(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
