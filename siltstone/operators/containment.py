"""Many fixed strings searched in all texts at once, by automata of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.staging import Stage

#: Needles of one automaton; more of them take more passes over the texts, none is refused.
AT_ONCE = 200_000


def contained(spark: SparkSession, texts: DataFrame, needles: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(key, and the columns of `needles` but `s`): every text of (key STRING, t) that contains the string `s` of a needle.

    Null and empty strings are in no text; rows of equal needles each give a row; a repeated key gives rows of its own.
    """
    stage = Stage(spark, "needles")
    rows = stage.put(needles.where("s <> ''").withColumn("_n", F.xxhash64("s")), "rows")
    one = stage.put(rows.groupBy("s").agg(F.min("_n").alias("_n")), "strings")
    passes = max(1, -(-one.count() // at_once))

    def search(part: int) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r["s"], r["_n"]) for r in one.where(F.pmod("_n", F.lit(passes)) == part).collect()])  # about at_once

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for s, n in sent.value:
                automaton.add_word(s, (n, s))
            automaton.make_automaton()
            for b in batches:
                found = [(k, n, s) for k, t in zip(b["key"], b["t"]) if t and sent.value for n, s in {v for _, v in automaton.iter(t)}]
                yield pd.DataFrame(found, columns=["key", "_n", "s"])

        return texts.select("key", "t").mapInPandas(run, "key string, _n long, s string")

    hits = reduce(DataFrame.union, [search(k) for k in range(passes)])
    return hits.join(rows, ["_n", "s"]).drop("_n", "s")
