"""Resumable translation of text columns by a caller-supplied function.

The function is `translate(texts, target_language) -> texts`. Texts are cut into
lines or sentences and put together again by native columns; only the segments
of the columns to translate travel to Python, in Arrow batches.
"""

import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.functions import text
from prefboard.functions.hashing import part
from prefboard.functions.portions import joined, portions
from prefboard.operators.answers import prompt_key
from prefboard.operators.sampling import random_subset
from prefboard.operators.shape import is_code, require_columns
from prefboard.session import fresh_path, materialise, spread
from prefboard.sources.batches import Batches, has_files

SEGMENTERS = {
    "lines": (text.lines, text.join_lines),
    "sentences": (text.sentences, text.join_sentences),
    "whole": (lambda c: F.when(c.isNotNull(), F.array(c)), lambda s: F.array_join(s, "")),
}


def untranslated(pairs: DataFrame, done: DataFrame, target_language: str) -> DataFrame:
    """Pairs whose id has no row in `done` for the target language yet."""
    written = done.where(F.col("target_language") == target_language).select("id")
    return pairs.join(written, "id", "left_anti")


def _in_batches(translate, target_language, batch_size, normalize):
    """Function of any number of texts that calls `translate` with at most `batch_size`.

    With `normalize` every text is brought to NFKC without line breaks. The separators
    put between segments never combine with their neighbours, so this equals normalising
    the joined text and saves a second way to Python.
    """

    def finish(translated):
        if not normalize:
            return list(translated)
        return [unicodedata.normalize("NFKC", t.replace("\n", "")) for t in translated]

    def run(texts):
        out = []
        for start in range(0, len(texts), batch_size):
            out.extend(finish(translate(texts[start : start + batch_size], target_language)))
        if len(out) != len(texts):
            raise ValueError("the translate function must return one text per text")
        return out

    return run


def _translated_segments(translate, target_language, batch_size, normalize):
    """Column function: array of segments -> array of translated segments."""
    in_batches = _in_batches(translate, target_language, batch_size, normalize)

    def translated(cells):
        out = in_batches([s for cell in cells if cell is not None for s in cell])
        at = 0
        for cell in cells:
            if cell is None:
                yield None
            else:
                yield out[at : at + len(cell)]
                at += len(cell)

    @F.arrow_udf(returnType=T.ArrayType(T.StringType()))
    def run(cells: pa.Array) -> pa.Array:
        return joined((list(translated(part)) for (part,) in portions(cells)), pa.list_(pa.string()))

    return run.asNondeterministic()


def translate_columns(
    pairs: DataFrame,
    columns,
    translate,
    target_language: str,
    segment="lines",
    batch_size=32,
    normalize=False,
    code_prompt_only=True,
) -> DataFrame:
    """Translates `columns`, passes the others through, adds `target_language`.

    Rows of code subsets have only their prompt translated. `normalize` brings
    translated texts to NFKC.
    """
    require_columns(pairs, columns)
    run = _translated_segments(translate, target_language, batch_size, normalize)
    rejoin = SEGMENTERS[segment][1]
    cells = _cells(pairs, columns, segment, code_prompt_only)
    done = pairs.withColumns({f"_new_{c}": rejoin(run(cell)) for c, cell in cells.items()})
    return _merged(done, pairs, columns, target_language, code_prompt_only)


def _untouched(pairs, code_prompt_only):
    """Rows of which only the prompt is translated."""
    return is_code() if code_prompt_only and "subset" in pairs.columns else F.lit(False)


def _cells(pairs, columns, segment, code_prompt_only):
    """The segments of every column to translate, null where it is not translated."""
    split, untouched = SEGMENTERS[segment][0], _untouched(pairs, code_prompt_only)
    return {c: split(F.col(c)) if c == "prompt" else F.when(~untouched, split(F.col(c))) for c in columns}


def _merged(done, pairs, columns, target_language, code_prompt_only):
    """Translated columns `_new_<name>` in place of the old ones, and `target_language`."""
    untouched = _untouched(pairs, code_prompt_only)
    kept = {c: F.col(c) if c == "prompt" else F.when(untouched, F.col(c)) for c in columns}
    merged = done.withColumns({c: F.coalesce(F.col(f"_new_{c}"), kept[c]) for c in columns})
    return merged.drop(*[f"_new_{c}" for c in columns]).withColumn("target_language", F.lit(target_language))


#: Segments that stand in more than one of so many places are joined by broadcast: at most as many rows.
FREQUENT = 1000


def translate_distinct(
    pairs: DataFrame, columns, translate, target_language: str, store, keys=("id",), segment="lines", batch_size=32,
    normalize=False, code_prompt_only=True, parts=1, tasks=None,
) -> DataFrame:
    """`translate_columns` that translates every different segment once.

    Segments of all rows and columns are brought together by their digest; what the
    store (`answers.AnswerStore`) does not know yet is translated, in `parts` parts that
    a stopped job keeps, and goes back to its rows by row and place. `keys` identify a
    row. A segment that stands in very many places is sent to all tasks, of which there
    are few; so it is no hot key.
    """
    require_columns(pairs, columns)
    keys, rejoin = list(keys), SEGMENTERS[segment][1]
    numbers = F.array(
        *[
            F.struct(F.lit(i).alias("column"), cell.alias("segments"))
            for i, cell in enumerate(_cells(pairs, columns, segment, code_prompt_only).values())
        ]
    )
    cells = pairs.select(*keys, F.inline(numbers)).where("segments is not null")
    places = cells.select(*keys, "column", F.posexplode("segments").alias("place", "segment"))
    system = F.lit(None).cast("string")
    places = places.withColumn("key", prompt_key(system, F.col("segment")))
    run = _in_batches(translate, target_language, batch_size, normalize)
    asked = places.select("key", system.alias("system_prompt"), F.col("segment").alias("user_prompt"))
    store.ask(asked, {target_language: lambda systems, users: run(users)}, parts, tasks)

    known = store.known().where(F.col("judge") == target_language).groupBy("key").agg(F.max("answer").alias("answer"))
    narrow = places.select(*keys, "column", "place", "key")
    counts = materialise(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "segment-counts")
    total = counts.agg(F.sum("n")).scalar()
    often = counts.where(F.col("n") * FREQUENT > total).select("key")
    frequent = materialise(known.join(F.broadcast(often), "key"), "frequent-segments")  # fewer than FREQUENT rows
    marked = narrow.join(F.broadcast(frequent.withColumnRenamed("answer", "shared")), "key", "left")
    rare = marked.where("shared is null").join(known, "key", "left")
    lost = F.raise_error(F.lit("a segment has no translation"))
    found = marked.where("shared is not null").select(*keys, "column", "place", F.col("shared").alias("answer"))
    found = found.unionByName(rare.select(*keys, "column", "place", F.coalesce("answer", lost).alias("answer")))

    def of_column(i):
        listed = F.array_sort(F.collect_list(F.when(F.col("column") == i, F.struct("place", "answer"))))
        return F.transform(listed, lambda s: s["answer"])

    new = found.groupBy(*keys).agg(*[of_column(i).alias(f"_new_{c}") for i, c in enumerate(columns)])
    new = new.withColumns({f"_new_{c}": F.when(F.size(f"_new_{c}") > 0, rejoin(F.col(f"_new_{c}"))) for c in columns})
    return _merged(pairs.join(new, keys, "left"), pairs, columns, target_language, code_prompt_only)


class Output:
    """Translated rows of a job, as batches, and the ids of every batch beside them.

    Files of rows and ids are written first and the batch is closed behind both. What a
    stopped job wrote of an open batch is no part of the output: it is neither read nor
    searched for ids, and its rows are translated again.
    """

    def __init__(self, spark, path, fmt="json", id_type="long"):
        self._spark = spark
        self._rows, self._ids = Batches(spark, path, fmt), Batches(spark, f"{str(path).rstrip('/')}.ids")
        self._id_type = id_type

    def done(self) -> DataFrame:
        """`id, target_language` of all rows of closed batches."""
        return self._ids.read(f"id {self._id_type}, target_language string", self._rows.closed())

    def add(self, translated: DataFrame, ids: DataFrame) -> None:
        """Adds the rows of one batch, whose ids (`id, target_language`) are `ids`."""
        batch = uuid.uuid4().hex
        self._ids.store(ids, batch)
        keys = ["target_language", "subset"]
        self._rows.store(translated.hint("rebalance", *[F.col(k) for k in keys]), batch, keys)
        self._rows.close(batch)

    def read(self, schema) -> DataFrame:
        """Rows of all closed batches."""
        return self._rows.read(schema)


def run_translation(
    pairs, path, columns, translate, target_language, parts=1, tasks=None, size=None, fmt="json", **options
) -> None:
    """Translates what `path` lacks and appends it; a stopped job can be run again.

    What is to do is found and written once, in `parts` even parts by a hash of the
    id; every part is then read from its own folder and is a batch of the output, so a
    job that ends early loses one part at most. `read_translation` reads the output.
    `size` translates a random subset only, the same in every run.
    """
    spark = pairs.sparkSession
    output = Output(spark, path, fmt, pairs.schema["id"].dataType.simpleString())
    todo = random_subset(pairs, size, groups=(), keys=("id",)) if size else pairs
    todo = untranslated(todo, output.done(), target_language)
    stored = fresh_path(spark, "to-translate")
    numbered = todo.withColumn("_part", part("part", 0, parts, "id").cast("int"))
    numbered.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(stored)
    for number in range(parts):
        folder = f"{stored}/_part={number}"
        if not has_files(spark, folder):
            continue
        rows = spark.read.schema(todo.schema).parquet(folder)
        translated = translate_columns(spread(rows, tasks), columns, translate, target_language, **options)
        output.add(translated, rows.select("id", F.lit(target_language).alias("target_language")))


def read_translation(spark, path, schema, fmt="json") -> DataFrame:
    """Rows that `run_translation` has written to `path`, without those of parts in work."""
    return Output(spark, path, fmt).read(schema)


def translate_bilingual(pairs: DataFrame, translate, target_language: str, batch_size=32) -> DataFrame:
    """Turn-based pairs translated from the English columns of bilingual pairs.

    Line by line, NFKC-normalised; `language` becomes the target language.
    """
    columns = ["en_input", "en_chosen", "en_rejected"]
    moved = translate_columns(
        pairs, columns, translate, target_language, "lines", batch_size, normalize=True, code_prompt_only=False
    )
    user = text.message("user", F.col("en_input"))
    return moved.select(
        "id",
        "source",
        F.lit(target_language).alias("language"),
        F.col("en_input").alias("prompt"),
        F.array(user, text.message("assistant", F.col("en_chosen"))).alias("chosen"),
        F.array(user, text.message("assistant", F.col("en_rejected"))).alias("rejected"),
    )


# A replacement list for tests.
SAMPLE_DICTIONARY = [("the", "der"), ("and", "und"), ("tion", "zion"), ("ou", "u")]


def dictionary_translator(texts, target_language):
    """A rule-based translate function for tests; it marks every segment it is given."""
    out = []
    for t in texts:
        for word, other in SAMPLE_DICTIONARY:
            t = t.replace(word, other)
        out.append(f"<{t}>")
    return out
