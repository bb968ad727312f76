"""Rule tables against names: supplier matching, rulings, exclusions, tech flags.

Names are matched once each: the distinct names meet the rules through an index
of grams (``ruleindex``), the winner is an aggregate, and the mapping is joined
back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip_accents, truncate
from ledgerlake.operators.ruleindex import meet, small

def normal(name: Column, accents: bool = True) -> Column:
    return strip_accents(F.trim(name)) if accents else F.lower(F.trim(name))


def guard_verdict(name: Column, guards: list[dict]) -> Column:
    """Guards in order: struct (hit, result).  Each is a dict with any of all_of, any_of, none_of, exact and a result (None: no supplier)."""
    out = F.when(F.lit(False), F.struct(F.lit(False).alias("hit"), F.lit(None).cast("string").alias("result")))
    for g in guards:
        test = F.lit(True)
        if g.get("exact"):
            test = test & name.isin(list(g["exact"]))
        for part in g.get("all_of", ()):
            test = test & name.contains(part)
        if g.get("any_of"):
            hit = F.lit(False)
            for part in g["any_of"]:
                hit = hit | name.contains(part)
            test = test & hit
        for part in g.get("none_of", ()):
            test = test & ~name.contains(part)
        out = out.when(test, F.struct(F.lit(True).alias("hit"), F.lit(g.get("result")).cast("string").alias("result")))
    return out.otherwise(F.struct(F.lit(False).alias("hit"), F.lit(None).cast("string").alias("result")))


def match_supplier(names: DataFrame, patterns: DataFrame, *, col: str = "supplier_raw", guards: list[dict] | None = None, mode: str = "payments") -> DataFrame:
    """(col, supplier_canon) for every distinct name.

    First guard that fits decides; else the first word-boundary pattern by id
    (a regular expression), else the first substring by id.  Rules confirmed
    invalid are skipped.  Modes: payments (guards, accents folded), register (no
    guards, 'redacted' matches nothing), authority (accents kept, invalid rules
    stay), reclassify (patterns are literal text, no accents folded, 'redacted'
    matches nothing), touched (as reclassify, but any rule that fits counts, with
    its pattern as the result).  An empty canonical name is NULL.
    """
    literally = mode in ("reclassify", "touched")
    key = normal(F.col(col), accents=mode == "payments")
    distinct = names.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_key", key)
    rules = patterns if mode in ("authority", "touched") else patterns.where("coalesce(confirmed_invalid, 0) = 0")
    rules = rules.select(F.col("id").alias("_id"), F.lower("pattern").alias("_p"), F.col("pattern" if mode == "touched" else "canonical_name").alias("_canon"), (F.col("match_type") == "word_boundary").alias("_word"))
    literal = F.concat(F.lit(r"\b\Q"), F.col("_p"), F.lit(r"\E\b"))
    word = F.rlike("_key", literal if literally else F.concat(F.lit(r"\b(?:"), F.col("_p"), F.lit(r")\b")))
    fits = F.when(F.col("_word"), word).otherwise(F.col("_key").contains(F.col("_p")))
    found = meet(distinct, "_key", rules, "_p", fits, None if literally else F.col("_word"))
    hits = found.groupBy(col).agg(F.min_by("_canon", F.struct(F.when(F.col("_word"), 0).otherwise(1), F.col("_id"))).alias("_found"))
    out = distinct.join(hits, col, "left")
    if mode == "register" or literally:
        out = out.withColumn("_found", F.when(~F.col("_key").contains("redacted"), F.col("_found")))
    if guards and mode in ("payments", "authority"):
        verdict = guard_verdict(F.col("_key"), guards)
        out = out.withColumn("_g", verdict).withColumn("_found", F.when(F.col("_g.hit"), F.col("_g.result")).otherwise(F.col("_found")))
    return out.select(col, F.nullif(F.col("_found"), F.lit("")).alias("supplier_canon"))


def canonicalise(rows: DataFrame, patterns: DataFrame, *, col: str = "supplier_raw", **options) -> DataFrame:
    return rows.join(match_supplier(rows, patterns, col=col, **options), col, "left")


def _without(rows: DataFrame, cols: list[str], key: str, rules: DataFrame, pattern: str, test: Column | None = None) -> DataFrame:
    """``rows`` but those whose values of ``cols`` some rule fits: its pattern is in ``key`` (lower-cased), and ``test`` holds."""
    values = rows.select(*cols).distinct().withColumn("_key", F.lower(key))
    fits = F.col("_key").contains(F.col(pattern))
    hit = meet(values, "_key", rules, pattern, fits if test is None else fits & test).select(*(F.col(c).alias(f"_{c}") for c in cols)).distinct()
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(hit, same, "left_anti")


def drop_invalid_suppliers(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Canonical names that contain a pattern confirmed invalid."""
    bad = patterns.where("confirmed_invalid = 1").select(F.lower("pattern").alias("_p"))
    return _without(rows, ["supplier_canon"], "supplier_canon", bad, "_p")


def drop_invalid_services(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Services that contain an invalid keyword."""
    bad = words.where("ruling = 'invalid'").select(F.lower("keyword").alias("_k"))
    return _without(rows, ["service"], "service", bad, "_k")


def apply_exclusions(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Supplier contains A and (service or category contains B)."""
    rule = exclusions.select(F.lower("supplier_pattern").alias("_a"), F.lower("service_keyword").alias("_b"))
    either = F.coalesce(F.lower("service").contains(F.col("_b")), F.lit(False)) | F.coalesce(F.lower("category").contains(F.col("_b")), F.lit(False))
    return _without(rows, ["supplier_canon", "service", "category"], "supplier_canon", rule, "_a", either)


def gate_mixed(rows: DataFrame, suppliers: list[str], it_words: list[str], *, strict: list[str] = (), operational: list[str] = ()) -> DataFrame:
    """Listed suppliers keep IT-like services only; the strict ones also lose rows with an operational word anywhere."""
    it = F.lower("service").rlike(r"\b(it|ict)\b|" + "|".join(it_words))
    text = F.lower(F.concat_ws(" ", "supplier_raw", "service", "category"))
    busy = text.rlike("|".join(operational)) if operational else F.lit(False)
    return rows.where(~F.col("supplier_canon").isin(list(suppliers)) | (F.coalesce(it, F.lit(False)) & ~(F.col("supplier_canon").isin(list(strict)) & busy)))


def apply_row_rules(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Scoped rules in order; a rule's fields are SQL conditions joined by AND, its action 'drop' or 'internal'."""
    drop, internal = F.lit(False), F.lit(False)
    for r in rules:
        test = F.coalesce(F.expr(r["where"]), F.lit(False))
        drop, internal = (drop | test, internal) if r["action"] == "drop" else (drop, internal | test)
    return rows.where(~drop).withColumn("internal_provider", F.when(internal, 1).otherwise(F.col("internal_provider")))


def mark_invalid(rows: DataFrame, ruled: DataFrame) -> DataFrame:
    """Rows on an exact list (council, raw fragment, amount, period) become invalid."""
    r = ruled.select(F.col("council").alias("_c"), F.col("raw_part").alias("_r"), F.col("amount").alias("_a"), F.col("period").alias("_p")).distinct()
    keys = ["council", "supplier_raw", "amount", "period"]
    hit = rows.select(*keys).distinct().join(small(r), (F.col("council") == F.col("_c")) & (F.col("amount") == F.col("_a")) & (F.col("period") == F.col("_p")) & F.col("supplier_raw").contains(F.col("_r")), "left_semi").withColumn("_hit", F.lit(True))
    out = rows.join(hit, keys, "left")
    return out.withColumn("validation_status", F.when(F.col("_hit"), "invalid").otherwise(F.col("validation_status"))).drop("_hit").select(*rows.columns)


def flag_tech(entries: DataFrame, *, non_tech: list[str], ambiguous: list[str], signals: list[str], consultancies: list[str]) -> DataFrame:
    """Matched, unless the title has a non-tech word; an ambiguous one is forgiven, and a consultancy accepted, for a software signal."""
    title = F.lower("contract_title")
    has = lambda words: F.coalesce(title.rlike("|".join(words)), F.lit(False)) if words else F.lit(False)
    ok = F.col("supplier_canon").isNotNull() & ~has(non_tech) & (~has(ambiguous) | has(signals)) & (~F.col("supplier_canon").isin(list(consultancies)) | has(signals))
    return entries.withColumn("is_tech", F.coalesce(ok, F.lit(False)).cast("int"))


def changed_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules that only one of the two tables has, as they stand there."""
    cols = ["id", "pattern", "canonical_name", "match_type", "confirmed_invalid"]
    before, after = old.select(*cols), new.select(*cols)
    return before.exceptAll(after).unionByName(after.exceptAll(before))


def reclassified(entries: DataFrame, old: DataFrame, new: DataFrame, non_tech: list[str]) -> DataFrame:
    """Register entries after a change of the rule table, with new_canon, new_tech and change beside what they had.

    An entry whose supplier no changed rule fits, in its old or its new form,
    matches what it has always matched, so only names that some changed rule fits
    are matched again; ``matched`` (the canonical name by the old rules, NULL for
    none) has the others' verdict.  A matched entry is tech unless its title has a
    non-tech word; one that isn't is known by its supplier's own name, cut to 300.
    """
    touched = match_supplier(entries, changed_rules(old, new), col="supplier", mode="touched").where("supplier_canon IS NOT NULL").select("supplier")
    again = match_supplier(touched, new, col="supplier", mode="reclassify").select("supplier", F.col("supplier_canon").alias("_again"), F.lit(True).alias("_touched"))
    out = entries.join(again, "supplier", "left")
    canon = F.when(F.col("_touched"), F.col("_again")).otherwise(F.col("matched"))
    title = F.coalesce(F.lower("contract_title"), F.lit(""))
    barred = title.rlike("|".join(non_tech)) if non_tech else F.lit(False)
    tech = canon.isNotNull() & ~barred
    out = out.withColumns({"new_canon": F.when(tech, F.left(canon, F.lit(300))).otherwise(truncate(F.col("supplier"), 300, "")), "new_tech": tech.cast("int")})
    return out.withColumn("change", change_of(F.col("supplier_canon"), F.col("is_tech"), F.col("new_canon"), F.col("new_tech"))).drop("_again", "_touched")


def change_of(old_canon: Column, old_tech: Column, new_canon: Column, new_tech: Column) -> Column:
    """R11."""
    return F.when((old_tech == 0) & (new_tech == 1), "to tech").when((old_tech == 1) & (new_tech == 0), "from tech").when(~old_canon.eqNullSafe(new_canon), "canon only").otherwise("unchanged")


def first_rule(text: Column, rules: list[dict], extra: Column | None = None) -> Column:
    """R12 + W5: the first rule whose regexes hit the text (and whose tech demand holds), as struct (layer, sublayer, name)."""
    out = None
    for r in rules:
        test = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in r["patterns"]))
        if r.get("tech") and extra is not None:
            test = test & extra
        value = F.struct(F.lit(r["layer"]).alias("layer"), F.lit(r["sublayer"]).alias("sublayer"), F.lit(r["name"]).alias("name"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def tags(text: Column, rules: dict[str, list[str]]) -> Column:
    """All vendors any of whose regexes hits, as an array."""
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(v)) for v, ps in rules.items())))


def link_products(entries: DataFrame, products: DataFrame) -> DataFrame:
    """(entry_id, product_id) where supplier is equal, the title hits a product regex and no exclude regex."""
    p = products.select("product_id", F.col("supplier_canon").alias("_s"), F.concat(F.lit("(?i)"), F.array_join("patterns", "|")).alias("_hit"), F.when(F.size("exclude") > 0, F.concat(F.lit("(?i)"), F.array_join("exclude", "|"))).alias("_not"))
    title = F.col("contract_title")
    test = (F.col("supplier_canon") == F.col("_s")) & F.rlike(title, F.col("_hit")) & F.coalesce(~F.rlike(title, F.col("_not")), F.lit(True))
    return entries.join(small(p), test).select(F.col("id").alias("entry_id"), "product_id").distinct()


def build_products(defs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products with a display name, their capability rows and their area rows."""
    products = defs.select("product_id", "supplier_canon", F.when(F.col("vendor").isNotNull(), F.concat_ws(" ", "vendor", "product_name")).otherwise(F.col("product_name")).alias("display_name"))
    return products, defs.select("product_id", F.explode("capabilities").alias("capability")).distinct(), defs.select("product_id", F.explode("areas").alias("area")).distinct()


def rule_validation(canon: Column, text: Column, valid_p: list[str], invalid_p: list[str], valid_k: list[str], invalid_k: list[str]) -> Column:
    """Confirmed-valid pattern, confirmed-invalid pattern, valid keyword, invalid keyword, else uncertain."""

    def any_in(c: Column, parts: list[str]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.coalesce(F.lower(c).contains(p.lower()), F.lit(False))
        return out

    return F.when(any_in(canon, valid_p), "valid").when(any_in(canon, invalid_p), "invalid").when(any_in(text, valid_k), "valid").when(any_in(text, invalid_k), "invalid").otherwise("uncertain")
