"""Writers. Every writer is a distributed append or overwrite of row files."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefboard.operators.naming import result_key
from prefboard.operators.results import document_json


def write_json(df: DataFrame, path, mode="errorifexists") -> None:
    """One JSON object per line; null fields are written so that no column gets lost."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_translated(df: DataFrame, path, mode="errorifexists", fmt="json") -> None:
    """Translated pairs in one folder per target language and subset.

    Rebalancing gives every folder few files of even size and splits a folder that
    holds much of the data over several tasks.
    """
    keys = [F.col("target_language"), F.col("subset")]
    df.hint("rebalance", *keys).write.mode(mode).partitionBy("target_language", "subset").format(fmt).save(path)


def write_result_documents(documents: DataFrame, path) -> None:
    """One JSON document per model and language; a repeated run replaces its own.

    Folders are `language=<code>/model_key=<model with / as ___>`. Each run is one
    row after its aggregation, so each folder receives one file.
    """
    texts = document_json(documents).withColumn("model_key", result_key(F.col("model")))
    runs = texts.select("language", "model_key", F.col("document").alias("value"))
    _replace(runs, ["language", "model_key"], "text", path)


def write_instances(rows: DataFrame, path, mode="errorifexists", fmt="json") -> None:
    """Per-instance rows, as JSON lines or in another format of Spark's."""
    rows.write.mode(mode).format(fmt).save(path)


def replace_instances(rows: DataFrame, path, fmt="json") -> None:
    """Per-instance rows in one folder per language and model.

    A repeated run replaces its own rows. Rebalancing gives a run few even files
    and splits a large run over several tasks.
    """
    keyed = rows.withColumn("model_key", result_key(F.col("model")))
    keys = ["language", "model_key"]
    _replace(keyed.hint("rebalance", *[F.col(k) for k in keys]), keys, fmt, path)


def _replace(df, keys, fmt, path):
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .format(fmt)
        .save(path)
    )


def write_csv_table(df: DataFrame, path, mode="errorifexists", partition_by=()) -> None:
    """CSV with header; line breaks, quotes and outer white space survive.

    As usual for CSV, an empty text and null are both an empty cell. With
    `partition_by`, rebalancing gives every folder few files of even size.
    """
    spread = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    (
        spread.write.mode(mode)
        .partitionBy(*partition_by)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_label_matrix(labels: DataFrame, path, cells_per_file=10_000_000) -> None:
    """Labels (`model, language, instance_id, label`) as models x instances files.

    A file, below `language=<code>/chunk=<number>`, has about `cells_per_file` cells: some
    of the language's instances, for all models. Its first line names them; an instance
    without a label of a model is an empty cell. Cells are rows that are sorted and written
    with a comma behind each, so no line is put together in memory; the comma behind the
    last line is a line without a name. Models and instances must be free of commas,
    quotes and line breaks; at most one label of a model and an instance is expected.
    """
    named = F.concat_ws("", "model", F.col("instance_id").cast("string")).rlike('[,"\\r\\n]')
    known = labels.select(
        "language",
        F.when(named, F.raise_error(F.lit("a name with a comma, quote or line break"))).otherwise(F.col("model")).alias("model"),
        F.col("instance_id").cast("string").alias("instance_id"),
        F.col("label").cast("string").alias("label"),
    )
    sizes = known.groupBy("language").agg(F.ceil(F.count(F.lit(1)) / cells_per_file).cast("int").alias("chunks"))
    known = known.join(sizes, "language").withColumn("chunk", F.pmod(F.xxhash64("instance_id"), F.col("chunks")).cast("int")).drop("chunks")
    keys = ["language", "chunk"]
    of_file = W.partitionBy(*keys)
    places = known.select(*keys, "instance_id").distinct().withColumns(
        {"place": F.row_number().over(of_file.orderBy("instance_id")), "n": F.count(F.lit(1)).over(of_file)}
    )
    models = known.select(*keys, "model").distinct().withColumns(
        {"line": F.row_number().over(of_file.orderBy("model")), "next": F.lead("model").over(of_file.orderBy("model"))}
    )
    in_line = W.partitionBy(*keys, "model").orderBy("place")
    cells = known.join(places, [*keys, "instance_id"]).join(models, [*keys, "model"])
    cells = cells.withColumns({"before": F.lag("place", 1, 0).over(in_line), "last": F.lead("place").over(in_line).isNull()})
    commas = lambda n: F.expr(f"repeat(',', {n})")
    behind = F.concat(commas("n - place"), F.lit("\n"), F.coalesce("next", F.lit("")))
    value = F.concat(commas("place - before - 1"), F.coalesce("label", F.lit("")), F.when(F.col("last"), behind).otherwise(F.lit("")))
    rows = cells.select(*keys, "line", "place", value.alias("value"))
    first = models.where("line = 1").select(*keys, F.col("model").alias("first"))
    ends = F.when(F.col("place") == F.col("n"), F.concat(F.lit("\n"), "first")).otherwise(F.lit(""))
    header = places.join(first, keys).select(*keys, F.lit(0).alias("line"), "place", F.concat("instance_id", ends).alias("value"))
    corner = first.select(*keys, F.lit(0).alias("line"), F.lit(0).alias("place"), F.lit("model").alias("value"))
    every = rows.unionByName(header).unionByName(corner)
    ordered = every.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "line", "place")
    ordered.select(*keys, "value").write.partitionBy(*keys).option("lineSep", ",").text(path)
