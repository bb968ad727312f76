"""An index over rule patterns, so that a name meets only the rules that can fit it.

Every pattern that a name has to contain (a literal, or what a regular
expression demands literally) is filed under one of its three-letter grams, the
one that fewest rules share.  Names are taken apart into grams and meet the rules
by gram, in an equi-join; the pattern itself is tested on what has met.  Rules
that demand no three letters in a row are filed under the empty gram, which every
name then has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: A rule table of more rows is not broadcast; the join is then left to Spark.
BROADCAST_RULES = 50_000
_GAP = "\x01"


def small(rules: DataFrame) -> DataFrame:
    """``rules`` with a broadcast hint where a bounded count proves them few."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def grams(text: Column) -> Column:
    """The distinct grams of a text; none of a shorter one."""
    n = F.char_length(text)
    each = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda k: F.substr(text, k, F.lit(GRAM)))
    return F.when(n >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def demanded(pattern: Column) -> Column:
    """Of a regular expression's alternatives the longest text that each demands, as an array; '' where that is not plain to see.

    What is escaped, in brackets, in groups, optional or repeated by count is
    taken for a gap, so a demanded text may be shorter than it could be, never longer.
    """
    c = F.regexp_replace(pattern, r"\\.", _GAP)
    c = F.regexp_replace(c, r"\[\^?\]?[^\]]*\]", _GAP)
    for _ in range(4):
        c = F.regexp_replace(c, r"\([^()]*\)", _GAP)
    c = F.regexp_replace(c, r".[?*]|.\{[^}]*\}", _GAP)
    c = F.regexp_replace(c, r"[+.^$]", _GAP)
    longest = lambda a: F.aggregate(F.split(a, _GAP), F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))
    unclear = c.rlike(r"[(){}\[\]\\]") | pattern.rlike(r"\(\?[a-z]*x|\\q")
    return F.when(unclear, F.array(F.lit(""))).otherwise(F.transform(F.split(c, r"\|"), longest))


def indexed(rules: DataFrame, pattern: str, regex: Column | None = None) -> DataFrame:
    """``rules`` with a column _gram, a row for each gram that the rule is filed under.

    A gram is known by its text, not by a row's number: rules that come out of a
    shuffle stand in another order each time they are read, and they are read twice.
    """
    texts = F.array(F.col(pattern)) if regex is None else F.when(regex, demanded(F.col(pattern))).otherwise(F.array(F.col(pattern)))
    rules = rules.withColumn("_text", F.explode(texts))
    filed = rules.select("_text", F.explode_outer(grams(F.col("_text"))).alias("_gram"))
    shared = filed.groupBy("_gram").agg(F.count("*").alias("_n"))
    chosen = filed.join(shared, "_gram", "left").groupBy("_text").agg(F.coalesce(F.min_by("_gram", F.struct("_n", "_gram")), F.lit("")).alias("_gram"))
    return rules.join(chosen, "_text").drop("_text")


def meet(values: DataFrame, key: str, rules: DataFrame, pattern: str, test: Column, regex: Column | None = None) -> DataFrame:
    """Each row of ``values`` beside each rule that its text ``key`` passes ``test`` with; a rule of several alternatives may stand there twice.

    ``test`` has to imply that the text contains the pattern or, where ``regex`` holds, fits it.
    """
    index = indexed(rules, pattern, regex)
    everywhere = F.array(F.lit("")) if index.where("_gram = ''").limit(1).count() else F.array().cast("array<string>")
    return values.withColumn("_gram", F.explode(F.concat(grams(F.col(key)), everywhere))).join(small(index), "_gram").where(test).drop("_gram")
