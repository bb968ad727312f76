"""Text cleaning, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed folding table: accented Latin letters and their plain forms.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucn"


def sanitise(s: Column) -> Column:
    """Control characters and white-space runs become one space; trimmed; '' becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(s, r"[\x00-\x20\x7F ]+", " ")), F.lit(""))


def strip_accents(s: Column) -> Column:
    """Lower case with the letters of ACCENTED made plain."""
    return F.translate(F.lower(s), ACCENTED, PLAIN)


def fold_key(s: Column) -> Column:
    """Case-, accent- and trailing-space-insensitive grouping key."""
    return F.rtrim(strip_accents(s))


def truncate(s: Column, n: int, mark: str = "…") -> Column:
    """At most ``n`` characters, the last of them ``mark`` where something was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - len(mark))), F.lit(mark))).otherwise(s)


def strip_tags(s: Column, n: int) -> Column:
    """Without tags and characters beyond the basic plane, cut to ``n``."""
    plain = F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", ""), r"[\x{10000}-\x{10FFFF}]", "")
    return F.left(plain, F.lit(n))


def labelled_names(s: Column, label: str = "Company name") -> Column:
    """All values of ``label: value`` lines, joined by ' / '; NULL where there are none."""
    found = F.regexp_extract_all(s, F.lit(rf"(?im){label}:[ \t]*([^\r\n]+)"), 1)
    return F.nullif(F.array_join(F.transform(found, lambda x: F.trim(x)), " / "), F.lit(""))


def normalise_name(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """``col`` replaced through the dictionary ``names`` (variant, name) on lower(trim); unknown names stay.

    The dictionary is a rule table; Spark broadcasts it while its size allows.
    """
    key = names.select(F.lower(F.trim("variant")).alias("_k"), F.col("name").alias("_n")).dropDuplicates(["_k"])
    return df.join(key, F.lower(F.trim(F.col(col))) == F.col("_k"), "left").withColumn(col, F.coalesce("_n", col)).drop("_k", "_n")


def region_label(s: Column) -> Column:
    """A region's name, trimmed; one region is spelled in one way."""
    t = F.trim(s)
    return F.when(F.lower(t) == "yorkshire and the humber", "Yorkshire and the Humber").otherwise(t)


def lineage_year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\b(20\d\d)\b", 1), F.lit("")).cast("int")


def lineage_status(name: Column, has_code: Column) -> Column:
    """'tbd' or 'proposed' where the name says so; else 'live' for a body with an area code, 'proposed' for one without."""
    low = F.lower(name)
    return F.when(low.contains("tbd"), "tbd").when(low.contains("proposed"), "proposed").when(F.coalesce(has_code, F.lit(False)), "live").otherwise("proposed")


def urgency(end: Column, as_of: Column) -> Column:
    """'high' within 30 days of the end, 'medium' within 90, else NULL."""
    days = F.datediff(end, as_of)
    return F.when(days < 30, "high").when(days < 90, "medium")


def cpv_division(code: Column) -> Column:
    return F.left(code, F.lit(2))


#: Fixed set: CPV divisions that count as technology.
TECH_CPV = ("30", "32", "48", "64", "72", "73")


def nation_prefix(lad_code: Column) -> Column:
    return F.left(lad_code, F.lit(1))


def nation_name(prefix: Column) -> Column:
    return F.when(prefix == "E", "England").when(prefix == "S", "Scotland").when(prefix == "W", "Wales").when(prefix == "N", "Northern Ireland")
