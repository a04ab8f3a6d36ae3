"""Merging many token lists without a group in one task.

Lists of equal length are merged position by position, an aggregate that Spark
combines in every task before it shuffles, so a hub with a third of all templates
sends one row a position and task.  What is left, one list per length, is
aligned ``FAN_IN`` at a time, in rounds, until one list a key is left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .align import WILD, align_all

FAN_IN = 16


def merge_positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``tokens``: per position the token that all lists of the key have there, else ``<*>``.

    All lists of a key have one length.
    """
    places = rows.select(*keys, F.posexplode("tokens").alias("pos", "token"))
    agreed = places.groupBy(*keys, "pos").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    token = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(WILD))
    lists = agreed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("token")))).alias("places"))
    return lists.select(*keys, F.transform("places", lambda p: p["token"]).alias("tokens"))


def _align(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = [[x["tokens"] for x in row] for row in part.column("lists").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": part.column("key"), "slot": part.column("slot"),
                                              "tokens": pa.array([align_all(x) for x in lists], pa.list_(pa.string()))})


def align_lists(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``key`` and ``tokens``: the lists of ``rows(key, slot, tokens)`` aligned in the order of their slots (0, 1, 2, ...).

    ``fan_in`` neighbours are folded at a time, so a key's lists are spread over
    tasks and the rounds number log(lists of the largest key).
    """
    checkpoint_dir(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    cur = rows.select("key", F.col("slot").cast("long").alias("slot"), "tokens").checkpoint()
    while (cur.agg(F.max("slot")).first()[0] or 0) > 0:
        groups = (cur.groupBy("key", F.floor(F.col("slot") / fan_in).alias("slot"))
                  .agg(F.array_sort(F.collect_list(F.struct(F.col("slot").alias("at"), "tokens"))).alias("lists")))
        cur = groups.mapInArrow(_align, f"key {kind}, slot long, tokens array<string>").checkpoint()
    return cur.select("key", "tokens")


def merge_lists(rows: DataFrame) -> DataFrame:
    """``key`` and ``tokens``: lists of ``rows(key, tokens)`` merged, the same for any order of the rows.

    Lists of one length are merged by position first, then those of the
    lengths, from the shortest on, by alignment.
    """
    by_length = merge_positions(rows.select("key", F.size("tokens").alias("length"), "tokens"), ["key", "length"])
    slot = F.row_number().over(Window.partitionBy("key").orderBy("length")) - 1
    return align_lists(by_length.select("key", slot.alias("slot"), "tokens"))
