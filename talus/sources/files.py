"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from talus.functions import text as X
from talus.operators.rows import last_per_key
from talus.session import written

ANNOTATION_SCHEMA = "url string, route_name string, route_lineage string, str_label string, label int, keep string"

# What is written is read back as it was: quotes and blanks at the ends stay, and null and '' are told apart. No value
# holds a line break in the file, so a file of any size is read by many tasks.
NULL = r"\N"
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": NULL}
# Every backslash of a file starts one of these, so NULL is never a value.
ESCAPES = {"\\": r"\s", "\n": r"\n", "\r": r"\r"}


def _strings(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _escaped(column):
    for plain, coded in ESCAPES.items():  # the backslash first
        column = F.replace(column, F.lit(plain), F.lit(coded))
    return column


def _restored(column):
    for plain, coded in reversed(ESCAPES.items()):  # the backslash last
        column = F.replace(column, F.lit(coded), F.lit(plain))
    return column


def read_csv(spark: SparkSession, path: str, schema: str, foreign: bool = False) -> DataFrame:
    """Files of `write_csv`, split among tasks anywhere between two rows. `foreign` files were written elsewhere: their
    quoted values may hold line breaks, so each is one task, nothing is decoded, and nothing at all is null."""
    if foreign:
        return spark.read.schema(schema).options(**{**CSV, "nullValue": ""}).option("multiLine", True).csv(path)
    return _strings(spark.read.schema(schema).options(**CSV).csv(path), _restored)


def read_annotations(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """Annotation CSV; `keep` accepts the usual spellings of a boolean."""
    return read_csv(spark, path, ANNOTATION_SCHEMA, foreign).withColumn("keep", F.lower("keep").isin("true", "1", "1.0"))


def write_csv(df: DataFrame, path: str) -> None:
    _strings(df, _escaped).write.mode("overwrite").options(**CSV).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard. Rows are gathered by shard with a rebalance, which splits a shard that is too
    large for one task instead of writing it from one."""
    df.hint("rebalance", shard).write.mode("overwrite").partitionBy(shard).parquet(path)


# The columns of a training shard, in order, with their types.
SHARD_COLUMNS = {
    "image": "struct<bytes: binary, path: string>", "route_image_id": "int", "route_id": "int", "route_name": "string", "grade": "string",
    "type": "string", "description": "string", "location": "string", "gps": "string", "area_id": "int", "area_name": "string",
    "area_path": "string", "area_depth": "int", "filter_score": "float", "filter_model_version": "string",
}


def write_named_shards(df: DataFrame, path: str, shard: str = "shard", order: str = "idx", name: str = "train-%05d.parquet") -> int:
    """One file per value of `shard` (numbers from 0), called by `name`, rows in the order of `order`; the number of files.

    Tasks write the files below a hidden folder under Spark's own commit. Publishing them is a rename each, which moves no
    data, and happens only after all are complete; files of an earlier build are replaced."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    rows = df.repartition(shard).sortWithinPartitions(shard, order).drop(order)
    rows.write.option("maxRecordsPerFile", 0).partitionBy(shard).parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for folder in files.listStatus(hadoop(staging)):
        if folder.isDirectory() and folder.getPath().getName().startswith(f"{shard}="):
            number = int(folder.getPath().getName().split("=", 1)[1])
            parts = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            if len(parts) != 1:
                raise RuntimeError(f"shard {number} has {len(parts)} files")
            made.append((number, parts[0]))
    for old in files.listStatus(hadoop(path)):
        if old.isFile() and old.getPath().getName().endswith(".parquet"):
            files.delete(old.getPath(), False)
    for number, part in made:
        if not files.rename(part, hadoop(f"{path.rstrip('/')}/{name % number}")):
            raise RuntimeError(f"shard {number} could not be published")
    files.delete(hadoop(staging), True)
    return len(made)


def read_named_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all shards with `file`, the name of theirs."""
    return spark.read.schema(", ".join(f"{name} {kind}" for name, kind in SHARD_COLUMNS.items())).parquet(path).withColumn("file", F.col("_metadata.file_name"))


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    write_shards(df, path, batch)


def write_texts(df: DataFrame, path: str, folder: str, text: str, rows_per_file: int = 1000) -> None:
    """One text file per `rows_per_file` rows below a folder per value of `folder`."""
    df.select(folder, F.col(text).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(folder).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_versioned(df: DataFrame, path: str, version: str = "model_version") -> None:
    """Rewrite only the version partitions that occur in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def upsert_versions(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], arrival, version: str = "model_version") -> None:
    """Put rows into a table of `write_versioned`: of rows with the same keys and version the last of `incoming` (by `arrival`)
    replaces what is there.

    Partitions of versions that `incoming` does not name are neither read nor written. In the others the replaced rows are
    found by their keys alone, as places in files, and only these places meet the stored rows."""
    rows, _ = written(last_per_key(incoming, [*keys, version], arrival), "upsert-rows")
    names = [r[0] for r in rows.select(version).distinct().collect()]  # a partition each
    place = ["_file", "_row"]
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    table = spark.read.parquet(path).withColumn(version, F.col(version).cast("string")).where(F.col(version).isin(names))
    replaced = table.select(*keys, version, *where).join(rows.select(*keys, version), [*keys, version], "left_semi").select(*place)
    replaced, _ = written(replaced, "upsert-places")
    kept = table.select("*", *where).join(replaced, place, "left_anti").drop(*place)
    result, _ = written(kept.unionByName(rows.select(*kept.columns)), "upsert-versions")
    write_versioned(result, path, version)


def key_array(df: DataFrame, column: str) -> DataFrame:
    """Rows of a JSON array of strings as one-column keys."""
    return df.select(F.explode(F.from_json(column, "array<string>")).alias("url"))


def read_key_array(spark: SparkSession, path: str) -> DataFrame:
    return key_array(spark.read.text(path, wholetext=True), "value")


def tagged_map(df: DataFrame, column: str) -> DataFrame:
    """(url, route, tag) from a JSON object url -> {route, tag}."""
    return df.select(F.explode(F.from_json(column, "map<string,struct<route:string,tag:string>>")).alias("url", "v")).select("url", "v.route", "v.tag")


def read_tagged_map(spark: SparkSession, path: str) -> DataFrame:
    return tagged_map(spark.read.text(path, wholetext=True), "value")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS int)").alias("batch")).where(F.col("batch").isNotNull())


def write_progress(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("append").text(path)


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("digest").distinct()


def read_binary(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(name, path, length, content) of binary files; content is read only if it is selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(X.last_segment(F.col("path")).alias("name"), "path", "length", "content")


def with_existing_file(df: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """Rows whose file is present."""
    return df.join(files.select(F.col("name").alias(name)), name, "left_semi")


def with_content(df: DataFrame, name: str, files: DataFrame) -> DataFrame:
    return df.join(files.select(F.col("name").alias(name), "content"), name)
