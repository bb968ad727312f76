"""Pages: plain text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The named entities that are decoded; &amp; comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&pound;": "£", "&euro;": "€", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&amp;": "&"}
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; white space made single."""
    plain = F.regexp_replace(html, UNSEEN, " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(plain, r"<[^>]*>", " ")), r"\s+", " "))


def table_rows(pages: DataFrame, *, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, row_no, cells) of a page's first table."""
    table = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row_no", "_row"))
    cell = F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)
    text = F.transform(cell, lambda c: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"<[^>]*>", "")), r"\s+", " ")))
    return rows.select(id_col, "row_no", text.alias("cells")).where(F.size("cells") > 0)
