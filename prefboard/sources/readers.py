"""Readers for pairs, result documents, rewards and the CSV tables.

Schemas are given, never inferred, so no reader scans its input twice.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefboard import schemas
from prefboard.sources import blocks


def read_pairs(spark: SparkSession, path, language=None, split="filtered", fmt="parquet", schema=schemas.PAIR):
    """Preference pairs of one split; a partitioned `language` is pruned."""
    pairs = spark.read.format(fmt).schema(schema).load(path)
    if split is not None:
        pairs = pairs.where(F.col("split") == split)
    if language is not None:
        pairs = pairs.where(F.col("language") == language)
    return pairs


def read_result_documents(spark: SparkSession, path, multi_line=True, models=None, languages=None) -> DataFrame:
    """Result documents of every language folder below `path`, one per file.

    The language is the value of a `language=` folder or else the name of the
    folder that holds the file. With `languages` or `models`, only files that are
    named so are opened: those in a folder `model_key=<key>`, or whose own name is the
    key and then `-` or `.`; a model's key is its name with `/` as `___`. Of these,
    documents of the very models are kept.
    """
    documents = (
        spark.read.schema(schemas.DOCUMENT)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,txt}")
        .json(path)
    )
    file_path = F.col("_metadata.file_path")
    named = F.regexp_extract(file_path, "/language=([^/]+)/", 1)
    parent = F.element_at(F.split(file_path, "/"), -2)
    language = F.when(named != "", named).otherwise(parent)
    if languages is not None:
        documents = documents.where(language.isin(list(languages)))
    if models is not None:
        documents = documents.where(_named_after(file_path, models)).where(F.col("model").isin(list(models)))
    return documents.withColumn("language", language)


def _named_after(file_path, models):
    """Whether a file's path tells one of the models. It depends on the path alone, so
    other files are left out when they are listed.

    Paths are escaped; models with other signs than letters, digits, `.`, `_`, `-` are
    looked for in all files.
    """
    keys = [m.replace("/", "___") for m in models]
    if any(re.search(r"[^A-Za-z0-9._-]", k) for k in keys):
        return F.lit(True)
    file_name = F.element_at(F.split(file_path, "/"), -1)
    told = F.regexp_extract(file_path, "/model_key=([^/]+)/", 1).isin(keys)
    for key in keys:
        told = told | file_name.startswith(f"{key}-") | file_name.startswith(f"{key}.")
    return told


def parse_documents(texts: DataFrame, column="document") -> DataFrame:
    """Documents from a JSON text column, next to `language`."""
    return texts.select("language", F.from_json(column, schemas.DOCUMENT).alias("d")).select("language", "d.*")


def read_csv_table(spark: SparkSession, path, schema, line_breaks=False) -> DataFrame:
    """CSV files with header; quoted cells may contain quotes, and with `line_breaks` line breaks.

    Either way many tasks read one file.
    """
    if line_breaks:
        return blocks.read_csv_records(spark, path, schema)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_label_matrix(spark: SparkSession, path, language=None) -> DataFrame:
    """Models x instances label files as long `model, language, instance_id, label`.

    The first line of every file names its instances; a line may be of any length and is
    read by many tasks. Cells are names and numbers without quotes or commas; an empty
    cell has no label. A row may not have more cells than the first line. Without a
    `language`, the folder `language=<code>` of a file tells it.
    """
    cells = blocks.read_cells(spark, path)
    header = cells.where("line = 0 and place > 0").select("file_id", "place", F.col("value").alias("instance_id"))
    names = cells.where("line > 0 and place = 0 and value <> ''").select("file_id", "line", F.col("value").alias("model"))
    labels = cells.where("line > 0 and place > 0").join(header, ["file_id", "place"], "left").join(names, ["file_id", "line"])
    unnamed = F.raise_error(F.concat(F.lit("more cells than the header has in "), F.col("file")))
    told = F.regexp_extract("file", "/language=([^/]+)/", 1)
    return labels.select(
        "model",
        (F.lit(language) if language else F.when(told != "", told)).alias("language"),
        F.coalesce("instance_id", unnamed).alias("instance_id"),
        F.when(F.col("value") != "", F.col("value")).cast("double").cast("int").alias("label"),
    )


def read_rewards(spark: SparkSession, path, schema=schemas.REWARD) -> DataFrame:
    """Chosen and rejected scores, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_instances(spark: SparkSession, path, schema=schemas.INSTANCE_RESULT, fmt="json") -> DataFrame:
    """Per-instance rows written by `writers.write_instances` or `replace_instances`."""
    return spark.read.schema(schema).format(fmt).load(path)
