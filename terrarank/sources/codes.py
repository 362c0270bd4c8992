"""Dictionary codes for repeated words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from ..operators import rank

# The rating words, in code order.
RISK_WORDS = ["Very Low", "Relatively Low", "Relatively Moderate", "Relatively High", "Very High", "Not Applicable",
              "Insufficient Data", "No Rating", "No Expected Annual Losses"]


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(word, code) of all words of a column, in order of the words, from 0: any number of words."""
    words = df.select(F.col(column).alias("word")).filter("word IS NOT NULL").distinct()
    return rank.value_ranks(words, [], "word").select("word", F.col("below").alias("code"))


def encode_with(df: DataFrame, column: str, table: DataFrame, out: str = "code") -> DataFrame:
    """The word's code from a table; NULL stays NULL; a word that the table lacks fails the job."""
    named = table.select(F.col("word").alias("_word"), F.col("code").alias("_code"))
    unknown = F.raise_error(F.concat(F.lit("not a known word: "), F.col(column))).cast("bigint")
    code = F.when(F.col(column).isNull(), None).when(F.col("_code").isNotNull(), F.col("_code")).otherwise(unknown)
    return df.join(named, F.col(column) == F.col("_word"), "left").withColumn(out, code).drop("_word", "_code")


def decode_with(df: DataFrame, column: str, table: DataFrame, out: str = "word") -> DataFrame:
    """The code's word from a table."""
    named = table.select(F.col("word").alias("_word"), F.col("code").alias("_code"))
    return df.join(named, F.col(column) == F.col("_code"), "left").withColumn(out, F.col("_word")).drop("_word", "_code")


def encode(c: Column | str, words: Sequence[str]) -> Column:
    """The word's code; NULL stays NULL; an unknown word fails the job."""
    at = F.array_position(F.array(*[F.lit(w) for w in words]), col(c))
    return F.when(col(c).isNull(), None).when(at > 0, at - 1).otherwise(
        F.raise_error(F.concat(F.lit("not a known word: "), col(c))).cast("bigint"))


def decode(c: Column | str, words: Sequence[str]) -> Column:
    """A code's word; text that is already a word passes through."""
    code = col(c).try_cast("int")
    return F.when(code.isNull(), col(c).cast("string")).otherwise(F.get(F.array(*[F.lit(w) for w in words]), code))


def unknown_words(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Words outside the dictionary and how often they occur."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*words)).groupBy(column).agg(F.count("*").alias("rows"))
