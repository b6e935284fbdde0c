"""Answers of judges, kept while a run goes on.

Calls of a judge are paid for, so a run must not repeat them when it has stopped. An
answer belongs to a judge and a prompt, known by its digest. Prompts that have no answer
yet are dealt to parts; the answers of a part are one batch, which later runs read from
the moment it is closed. Equal prompts of any number of rows are asked once.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions.hashing import part
from prefboard.functions.portions import joined, portions
from prefboard.session import fresh_path, spread
from prefboard.sources.batches import Batches, has_files

SCHEMA = "key string, judge string, answer string"


def prompt_key(system: Column, user: Column) -> Column:
    """Digest of a prompt, null without a user prompt; a missing system prompt differs from an empty one."""
    shown = F.coalesce(F.concat(F.lit("s"), F.sha2(system, 256)), F.lit("-"))
    return F.when(user.isNotNull(), F.sha2(F.concat(shown, F.sha2(user, 256)), 256))


def _asking(judges):
    """Column function: judge's name, system and user prompt -> answer."""

    def answered(names, systems, users):
        answers = [None] * len(users)
        for name in dict.fromkeys(names):
            own = [i for i, n in enumerate(names) if n == name]
            given = list(judges[name]([systems[i] for i in own], [users[i] for i in own]))
            for i, answer in zip(own, given, strict=True):
                answers[i] = answer
        return answers

    @F.arrow_udf(returnType=T.StringType())
    def ask(names: pa.Array, systems: pa.Array, users: pa.Array) -> pa.Array:
        return joined((answered(*part) for part in portions(names, systems, users)), pa.string())

    return ask.asNondeterministic()


class AnswerStore:
    """Answers by judge and prompt in a folder that outlives the run."""

    def __init__(self, spark: SparkSession, path):
        self._spark = spark
        self._batches = Batches(spark, path)

    def known(self) -> DataFrame:
        """`key, judge, answer` of all finished parts."""
        return self._batches.read(SCHEMA)

    def missing(self, prompts: DataFrame, names) -> DataFrame:
        """`judge, key, system_prompt, user_prompt` of the prompts without an answer, each once per judge."""
        prompts = prompts.where("key is not null").groupBy("key")
        once = prompts.agg(F.first("system_prompt").alias("system_prompt"), F.first("user_prompt").alias("user_prompt"))
        asked = once.withColumn("judge", F.explode(F.array(*[F.lit(n) for n in names])))
        return asked.join(self.known().select("key", "judge"), ["key", "judge"], "left_anti")

    def ask(self, prompts: DataFrame, judges: dict, parts=1, tasks=None) -> None:
        """Asks every judge of `judges` (name: function) what it has not answered yet.

        `prompts` has `key, system_prompt, user_prompt`. What is to do is found and written
        once, in `parts` even parts; a run that stops loses the part in work at most. Calls
        that give no answer (null) are left out, so that the next run asks again.
        """
        todo = self.missing(prompts, list(judges))
        stored = fresh_path(self._spark, "to-ask")
        numbered = todo.withColumn("_part", part("ask", 0, parts, "key", "judge").cast("int"))
        numbered.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(stored)
        for number in range(parts):
            folder = f"{stored}/_part={number}"
            if not has_files(self._spark, folder):
                continue
            rows = spread(self._spark.read.schema(todo.schema).parquet(folder), tasks)
            answered = rows.withColumn("answer", _asking(judges)("judge", "system_prompt", "user_prompt"))
            self._batches.write(answered.where("answer is not null").select("key", "judge", "answer"))

    def attach(self, rows: DataFrame, names, key="prompt_key") -> DataFrame:
        """`rows` with `judgment_0`, `judgment_1`, ...: the answers of the named judges to the prompt `key`."""
        of = [F.max(F.when(F.col("judge") == n, F.col("answer"))).alias(f"judgment_{i}") for i, n in enumerate(names)]
        wide = self.known().where(F.col("judge").isin(*names)).groupBy(F.col("key").alias(key)).agg(*of)
        return rows.join(wide, key, "left")


def open_run(spark: SparkSession, folder) -> tuple:
    """`(store, finish)` of the run in `folder` that is not finished, or of a new one.

    A finished run's answers stay in its own folder; a repeated run asks anew.
    """
    runs = Batches(spark, f"{str(folder).rstrip('/')}/finished")
    number = len(runs.closed())
    return AnswerStore(spark, f"{str(folder).rstrip('/')}/run-{number}"), lambda: runs.close(f"run-{number}")
