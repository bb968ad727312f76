"""A positional inverted index: words, prefixes and phrases without a look at the texts.

The index is a table of (term, field, id, positions), range-partitioned and sorted
by term and id, so a term's rows lie together (a frequent one's in several files)
and a query on it, or on the range of terms that a prefix is, reads only the row
groups whose statistics have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip_accents

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text, accented Latin letters made plain."""
    return F.regexp_extract_all(strip_accents(text), F.lit(f"({WORD})"), 1)


def build_index(rows: DataFrame, key: str, fields: list[str], path: str, *, rows_a_group: int = 50_000) -> None:
    """writes the index over ``fields`` of ``rows`` to ``path``.  Null texts have no words; a key's rows count as one."""
    spread = rows.select(F.col(key).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("f"))
    placed = spread.select("id", "f.field", F.posexplode(words(F.coalesce("f.text", F.lit("")))).alias("pos", "term"))
    index = placed.groupBy("term", "field", "id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    index.repartitionByRange("term", "id", "field").sortWithinPartitions("term", "id", "field").write.option("parquet.block.row.count.limit", rows_a_group).parquet(path)


def open_index(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The index, or its part for some fields."""
    index = spark.read.parquet(path)
    return index.where(F.col("field").isin(fields)) if fields else index


def word(index: DataFrame, term: str) -> DataFrame:
    """The ids of rows with this word."""
    return index.where(F.col("term") == term.lower()).select("id").distinct()


def prefix(index: DataFrame, start: str) -> DataFrame:
    """The ids of rows with a word that starts so: the terms from it up to the next text that doesn't start so."""
    low = start.lower()
    after = low[:-1] + chr(ord(low[-1]) + 1)
    return index.where((F.col("term") >= low) & (F.col("term") < after)).select("id").distinct()


def phrase(index: DataFrame, terms: list[str]) -> DataFrame:
    """The ids of rows with these words one after the other in one field: each word's positions, moved back by its place, have to meet."""
    if len(terms) == 1:
        return word(index, terms[0])
    places = [index.where(F.col("term") == t.lower()).select("id", "field", F.explode("positions").alias("p")).select("id", "field", (F.col("p") - k).alias("start")) for k, t in enumerate(terms)]
    met = reduce(DataFrame.unionAll, places).groupBy("id", "field", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
    return met.select("id").distinct()


def any_phrase(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The ids of rows with any of the phrases (a supplier's name and its variants)."""
    return reduce(DataFrame.unionAll, [phrase(index, p) for p in phrases]).distinct()


def every(parts: list[DataFrame]) -> DataFrame:
    """The ids that all of the parts have."""
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), parts)
