"""Sources and sinks: message folders, maps, line files, delimited files, vectors, resumable output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.sources import schema

_FILE = r"([^/]+)_inspect\.json$"
_STEP = r"step_(\d+)_([^_/]+)_"


def handle_of(path: Column) -> Column:
    """The channel's handle, lower case, from a message file's path."""
    return F.lower(F.regexp_extract(path, _FILE, 1))


def step_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, _STEP, 1), F.lit("")).cast("int")


def folder_window(folder: Column) -> tuple[Column, Column]:
    """(start, end) of a folder named step_NN_tag_YYYYMMDD_YYYYMMDD; null where a part is missing."""
    parts = F.split(F.element_at(F.split(folder, "/"), -1), "_")
    day = lambda i: F.try_to_timestamp(F.get(parts, F.lit(i)), F.lit("yyyyMMdd"))
    five = F.size(parts) == 5
    return F.when(five, day(3)), F.when(five, day(4))


def step_folder(folders: DataFrame, step: int, tag: str) -> DataFrame:
    """The one folder (column path) of a step; an error if there is none or more than one."""
    found = folders.filter(F.col("path").rlike(rf"step_{step:02d}_{tag}_[^/]*$")).distinct()
    n = found.count()
    if n != 1:
        raise ValueError(f"step {step} {tag} has {n} folders")
    return found


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths only: the column pruning of binaryFile keeps contents unread."""
    return spark.read.format("binaryFile").load(glob).select("path")


def first_files(files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One file (path) per canonical channel: the first by step, tag, path. Runs on the file list, before
    any row is read."""
    named = files.select("path", handle_of(F.col("path")).alias("handle"), F.regexp_extract("path", _STEP, 1).alias("step"), F.regexp_extract("path", _STEP, 2).alias("tag"))
    if aliases is not None:
        named = named.join(aliases.select(F.col("alias").alias("handle"), "canonical"), "handle", "left").withColumn("channel", F.coalesce("canonical", "handle"))
    else:
        named = named.withColumn("channel", F.col("handle"))
    order = Window.partitionBy("channel").orderBy("step", "tag", "path")
    return named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("channel", "path")


def read_messages(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects): arrays of objects, a file per channel. A file or row that can't be parsed goes
    to rejects, with its path, and is counted rather than lost."""
    raw = (
        spark.read.schema(schema.MESSAGE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("channel", handle_of(F.col("path")))
    )
    # Both tests name a data column too: Spark parses nothing for the reject column alone.
    good, bad = "_corrupt_record is null or id is not null", "_corrupt_record is not null and id is null"
    return raw.filter(good).drop("_corrupt_record"), raw.filter(bad).select("path", "_corrupt_record")


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) rows of one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def read_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """One JSON object a line."""
    return spark.read.schema(columns).json(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: str | None = None) -> DataFrame:
    """Delimited text with a header, gzip by its suffix; a byte-order mark on the first name goes."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = reader.schema(columns).csv(path) if columns else reader.csv(path)
    return df.toDF(*[c.replace("﻿", "").strip('"') for c in df.columns])


def write_delimited(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Arrays as |-joined text, nulls as empty fields."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec) from Parquet; vectors are arrays of floats."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))


def row_count(spark: SparkSession, path: str, header: bool = True) -> int:
    """Records of a delimited file, without its header."""
    return spark.read.option("header", header).csv(path).count()


def resume_groups(work: DataFrame, group: str, done_path: str, run) -> DataFrame:
    """Output in groups: those already below ``done_path`` are skipped, each other one is appended as a
    partition. ``run`` maps the rows still to do to output rows that carry the group column."""
    spark = work.sparkSession
    try:
        done = spark.read.parquet(done_path).select(F.col(group).cast(dict(work.dtypes)[group])).distinct()
        todo = work.join(done, group, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = work
    run(todo).write.mode("append").partitionBy(group).parquet(done_path)
    return spark.read.parquet(done_path)
