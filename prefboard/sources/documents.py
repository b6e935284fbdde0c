"""Result lists inside stored JSON documents, read without any document in one row.

A document may hold a list of any length (`scores.results`). Files are cut at commas, so
that many tasks read one list; pieces that are a plain number are the list's elements and
stay where they are. Only the few other pieces of a file are brought together: they show,
as JSON with all plain pieces left out, where the list begins and ends.
"""

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefboard.sources.blocks import pieces

_PLAIN = r"^\s*(-?[0-9][0-9.eE+-]*|-?Infinity|NaN|null)\s*$"
_EVENT = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]', re.S)
LIST = ("scores", "results")
_KINDS = {"document": T.StringType(), "first": T.LongType(), "last": T.LongType(), "head": T.StringType(), "tail": T.StringType()}
_LISTS = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()]))


def lists_in(numbers, texts, path=LIST):
    """Documents of one file, with the pieces in which the list at `path` begins and ends.

    `texts` are the pieces of the file but for plain numbers, `numbers` their places. `head`
    and `tail` are what stands in the first and the last piece inside the list; for a list
    within one piece `head` is all of it and `tail` is missing.
    """
    text, starts = ",".join(texts), []
    for piece in texts:
        starts.append(starts[-1] + 1 + length if starts else 0)
        length = len(piece)
    found, stack, key, began, opened = [], [], None, 0, None
    at = 0  # piece of the event in hand
    for event in _EVENT.finditer(text):
        while at + 1 < len(starts) and starts[at + 1] <= event.start():
            at += 1
        sign = event[0]
        if sign in "{[":
            if not stack:
                began, opened, document = event.start(), None, None
            stack.append((sign, key))
            if sign == "[" and tuple(k for _, k in stack[1:]) == path:
                opened = (at, event.end(), len(stack))
            key = None
        elif sign in "}]":
            if opened and len(stack) == opened[2] and len(opened) == 3:
                opened += (at, event.start())
            stack.pop()
            if not stack:
                document = text[began : event.end()]
                row = dict(document=document, first=None, last=None, head=None, tail=None)
                if opened:
                    first, inside, _, last, end = opened
                    row |= {"first": numbers[first], "last": numbers[last]}
                    row["head"] = text[inside : end if first == last else starts[first] + len(texts[first])]
                    row["tail"] = text[starts[last] : end] if first != last else None
                found.append(row)
        elif sign[0] == '"':
            key = sign[1:-1] if stack and stack[-1][0] == "{" and text[event.end() :].lstrip()[:1] == ":" else key
    return found


@F.pandas_udf(_LISTS)
def _lists(parts: pd.Series) -> pd.Series:
    return parts.map(lambda ps: lists_in([int(p["number"]) for p in ps], [p["value"] for p in ps]))


def read_instance_lists(spark: SparkSession, path) -> DataFrame:
    """`language, model, position, result` of the result lists in all documents below `path`.

    A document that holds a part of a list says at which `position_offset` it begins. The
    language is the value of a `language=` folder, or else the name of the folder that
    holds the file. Files may have several documents, of one line or many. Elements are
    numbers; null has no result.
    """
    cut = pieces(spark, path, ",", recursiveFileLookup=True, pathGlobFilter="*.{json,txt}").withColumn("at", F.monotonically_increasing_id())
    sizes = cut.groupBy("file", "start", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    # a range's numbers have no gaps; one short row per range
    shift = sizes.select("block", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"))
    numbered = cut.join(F.broadcast(shift), "block").select("file", (F.col("at") + F.col("shift")).alias("number"), "value")
    plain = F.col("value").rlike(_PLAIN)

    others = numbered.where(~plain).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("parts"))
    documents = others.select("file", F.inline(_lists("parts"))).where("first is not null")
    known = F.from_json("document", "model string, position_offset long")
    parent = F.element_at(F.split("file", "/"), -2)
    named = F.regexp_extract("file", "/language=([^/]+)/", 1)
    documents = documents.select(
        "file",
        F.when(named != "", named).otherwise(parent).alias("language"),
        known["model"].alias("model"),
        F.coalesce(known["position_offset"], F.lit(0)).alias("offset"),
        "first",
        "last",
        "head",
        "tail",
    )
    result = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s", "")), F.lit("null")).cast("double")
    inner = numbered.where(plain).join(documents, "file").where("number > first and number < last")
    inner = inner.select("language", "model", (F.col("offset") + F.col("number") - F.col("first")).alias("position"), result("value").alias("result"))
    ends = F.array(
        F.struct(F.col("offset").alias("position"), F.col("head").alias("value")),
        F.struct((F.col("offset") + F.col("last") - F.col("first")).alias("position"), F.col("tail").alias("value")),
    )
    outer = documents.select("language", "model", F.inline(ends)).where(r"value is not null and not value rlike '^\\s*$'")
    outer = outer.select("language", "model", "position", result("value").alias("result"))
    return inner.unionByName(outer)


def write_instance_lists(rows: DataFrame, path, elements=10_000) -> None:
    """Rows `language, model, position, result` as documents with parts of at most so many results.

    Each document is one line; its `position_offset` is the position of its first result.
    Positions of a model and language count from 0 without gaps.
    """
    part = F.floor(F.col("position") / elements)
    parts = rows.groupBy("language", "model", part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "result"))), lambda r: r["result"]).alias("results")
    )
    document = F.to_json(
        F.struct("model", (F.col("part") * elements).alias("position_offset"), F.struct("results").alias("scores")),
        {"ignoreNullFields": "false"},
    )
    parts.select("language", document.alias("value")).write.partitionBy("language").text(path)
