"""Amounts from text.  Nothing raises; what can't be read is NULL or 0 as said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_REGISTER_VALUE = 9_999_999_999_999


def leading_number(s: Column) -> Column:
    """The numeric prefix as decimal(14,2), 0 where there is none."""
    prefix = F.regexp_extract(s, r"^-?[0-9]*\.?[0-9]*", 0)
    return F.round(F.coalesce(prefix.try_cast("decimal(18,4)"), F.lit(0)), 2).cast("decimal(14,2)")


def repair_split_pence(s: Column) -> Column:
    """'888361 71' is 888361.71: a space in place of the point."""
    return F.regexp_replace(F.trim(s), r"^(-?[0-9]+)\s([0-9]{1,2})$", "$1.$2")


def parse_amount_spend(s: Column, *, repair: Column | bool = False, absolute: Column | bool = False) -> Column:
    """Payment amount: negatives stay, exact zero is NULL (the row drops)."""
    repair, absolute = (x if isinstance(x, Column) else F.lit(x) for x in (repair, absolute))
    kept = F.regexp_replace(F.regexp_replace(F.when(repair, repair_split_pence(s)).otherwise(s), "[^0-9.,-]", ""), ",", "")
    value = leading_number(kept)
    return F.nullif(F.when(absolute, F.abs(value)).otherwise(value), F.lit(0).cast("decimal(14,2)"))


def parse_amount_authority(s: Column) -> Column:
    """As above with a trailing minus; zero and below is NULL."""
    kept = F.regexp_replace(s, "[^0-9.,-]", "")
    kept = F.regexp_replace(F.when(kept.endswith("-"), F.concat(F.lit("-"), F.rtrim(kept, F.lit("-")))).otherwise(kept), ",", "")
    value = leading_number(kept)
    return F.when(value > 0, value)


def parse_amount_register(s: Column) -> Column:
    """First monetary token of a register value; NULL where there is none or it is beyond belief."""
    plain = F.regexp_replace(s, r"(?i)\b([0-9]+)(st|nd|rd|th)\b", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), r"(?i)\b(p\.?a\.?|per\s*annum|per\s*year)\b.*", "")
    token = F.regexp_extract(F.replace(plain, F.lit("£"), F.lit("")), r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?", 0)
    value = F.regexp_replace(token, ",", "").try_cast("decimal(38,4)")
    return F.when(F.abs(value) <= MAX_REGISTER_VALUE, F.round(value, 2).try_cast("decimal(18,2)"))
