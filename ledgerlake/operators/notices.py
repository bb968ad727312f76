"""Procurement notices: flattening, upsert, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import TECH_CPV, cpv_division, strip_accents, strip_tags
from ledgerlake.operators.filters import tender_state
from ledgerlake.operators.ruleindex import small

SEPARATOR = " | "
#: Columns that take the newest value, the newest that isn't missing, and the first that isn't missing.
ALWAYS = ("title", "status", "stage")
FILLED = ("value_amount", "cpv_division", "region", "tender_end_date", "official_url", "supplier_names", "description")
FIRST = ("published_date", "buyer_name", "source", "value_currency")


#: Statuses that a tender may have; any other is active.
STATUSES = ("active", "planned", "cancelled", "complete")
#: Documents that are a notice's own page, in releases and in compiled releases.
NOTICE_DOCUMENTS = ("tenderNotice", "awardNotice", "plannedProcurementNotice")
COMPILED_DOCUMENTS = ("tenderNotice", "awardNotice", "contractNotice", "plannedProcurementNotice")
#: Statuses of compiled releases.
COMPILED_STATUS = {"active": "active", "planned": "planned", "planning": "planned", "complete": "complete", "cancelled": "cancelled", "unsuccessful": "cancelled", "withdrawn": "withdrawn"}


def _some(array: str) -> Column:
    return F.size(F.coalesce(F.col(array), F.array())) > 0


def _given(amount: Column) -> Column:
    """An amount that is there and not zero."""
    return F.coalesce(amount != 0, F.lit(False))


def _named(array: Column) -> Column:
    """The distinct names of an array of structs, without empty ones; an empty array where there is none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(array, F.array()), lambda s: s["name"]), lambda n: n.isNotNull() & (n != "")))


def _awarded() -> Column:
    each = F.transform(F.coalesce("awards", F.array()), lambda a: F.transform(F.coalesce(a["suppliers"], F.array()), lambda s: s["name"]))
    return F.array_distinct(F.filter(F.flatten(each), lambda n: n.isNotNull() & (n != "")))


def _notice_url(documents: Column, kinds: tuple[str, ...]) -> Column:
    """The url, if any, of the first document of these kinds."""
    return F.get(F.filter(documents, lambda d: F.coalesce(d["documentType"].isin(*kinds), F.lit(False))), 0)["url"]


def _flat(releases: DataFrame, source: str, **own: Column) -> DataFrame:
    """The columns that releases and compiled releases share, and those that they don't."""
    places = F.transform(F.coalesce("tender.items", F.array()), lambda i: F.transform(F.coalesce(i["deliveryAddresses"], F.array()), lambda d: d["region"]))
    place = F.get(F.filter(F.flatten(places), lambda r: r.isNotNull() & (r != "")), 0)
    code = F.nullif(F.col("tender.classification.id"), F.lit(""))
    own = {
        "release_date": F.left("date", F.lit(10)), "buyer_name": F.col("buyer.name"), "cpv_division": cpv_division(code), "cpv_codes": code, "region": place,
        "tender_end_date": F.left("tender.tenderPeriod.endDate", F.lit(10)).try_cast("date"), "source": F.lit(source),
    } | own
    own |= {"title": strip_tags(own["title"], 500), "description": strip_tags(own["description"], 1000), "value_amount": own["value_amount"].cast("decimal(15,2)"), "supplier_names": F.nullif(F.array_join(own["supplier_names"], SEPARATOR), F.lit(""))}
    return releases.where("ocid <> '' AND buyer.name <> ''").select("ocid", *(c.alias(name) for name, c in own.items()))


def flatten_releases(releases: DataFrame, source: str = "releases") -> DataFrame:
    """A release's flat notice.  Rows without ocid or buyer drop; dates are cut to the day.

    The value is the first award's, if not zero, else the tender's; the currency
    is the tender's, else the first award's.  The url is that of the first notice
    document, of the tender, then of its planning.
    """
    tag = lambda *names: F.coalesce(F.arrays_overlap("tag", F.array(*map(F.lit, names))), F.lit(False))
    stage = F.when(tag("award", "awardUpdate"), "award").when(tag("tender", "tenderAmendment"), "tender").when(tag("planning"), "planning").otherwise("active")
    award, tender = F.get("awards", 0), F.lower("tender.status")
    none = F.array().cast("array<struct<documentType:string,url:string,description:string>>")
    documents = F.concat(F.coalesce("tender.documents", none), F.coalesce("planning.documents", none))
    amount = award["value"]["amount"]
    return _flat(
        releases, source, stage=stage,
        status=F.when(stage == "award", F.when(award["status"] == "cancelled", "cancelled").otherwise("complete")).when(tender.isin(*STATUSES), tender).otherwise("active"),
        value_amount=F.when(_given(amount), amount).otherwise(F.nullif(F.col("tender.value.amount"), F.lit(0.0))),
        value_currency=F.coalesce(F.col("tender.value.currency"), award["value"]["currency"], F.lit("GBP")),
        supplier_names=_awarded(), published_date=F.left(F.coalesce("date", "tender.datePublished"), F.lit(10)).try_cast("date"), official_url=_notice_url(documents, NOTICE_DOCUMENTS),
        title=F.coalesce(F.col("tender.title"), F.get("planning.documents", 0)["description"], F.lit("")), description=F.coalesce("tender.description", F.lit("")),
    )


def flatten_compiled(releases: DataFrame, region: str, source: str = "compiled") -> DataFrame:
    """As N1 for compiled releases, whose tags say nothing.

    The stage follows from contracts or awards being there; an unknown status is
    what the stage implies.  Value and currency are the first award's, else the
    tender's, else of the contracts (their sum, the last currency).  Suppliers
    are the parties' where no award names any, the region is ``region`` where
    none is named, the url is any first document's where no notice document has
    one, title and description fall back to the first contract and the release.
    """
    raw, award = F.lower(F.coalesce("tender.status", F.lit(""))), F.get("awards", 0)
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPILED_STATUS.items() for x in kv)), raw)
    stage = F.when(_some("contracts") | _some("awards"), "award").when(raw.isin("planned", "planning"), "planning").otherwise("tender")
    amount, tender = award["value"]["amount"], F.col("tender.value.amount")
    paid = F.transform(F.filter(F.coalesce("contracts", F.array()), lambda c: _given(c["value"]["amount"])), lambda c: c["value"])
    total = F.when(F.size(paid) > 0, F.aggregate(paid, F.lit(0.0), lambda n, v: n + v["amount"]))
    last = F.try_element_at(F.filter(F.transform(paid, lambda v: v["currency"]), lambda c: c.isNotNull()), F.lit(-1))
    currency = F.when(_given(amount), award["value"]["currency"]).when(_given(tender), F.col("tender.value.currency")).otherwise(last)
    supplied = F.filter(F.coalesce("parties", F.array()), lambda p: F.coalesce(F.array_contains(p["roles"], "supplier"), F.lit(False)))
    page = F.nullif(_notice_url(F.col("tender.documents"), COMPILED_DOCUMENTS), F.lit(""))
    out = _flat(
        releases, source, stage=stage, status=F.coalesce(known, F.when(stage == "award", "complete").otherwise("active")),
        value_amount=F.when(_given(amount), amount).when(_given(tender), tender).otherwise(total), value_currency=F.coalesce(currency, F.lit("GBP")),
        supplier_names=F.when(F.size(_awarded()) > 0, _awarded()).otherwise(_named(supplied)), published_date=F.left("date", F.lit(10)).try_cast("date"),
        official_url=F.coalesce(page, F.nullif(F.get("tender.documents", 0)["url"], F.lit(""))),
        title=F.coalesce(F.col("tender.title"), F.get("contracts", 0)["title"], F.lit("")), description=F.coalesce("tender.description", "description", F.lit("")),
    )
    return out.withColumn("region", F.coalesce("region", F.lit(region)))


#: Where ``upsert`` keeps the sequences of values that are not a row's newest.
SEQUENCES = "value_sequences"


def upsert(old: DataFrame | None, new: DataFrame, *, key: str = "ocid", sequence: str = "seq", track: bool = False) -> DataFrame:
    """One row a key from all versions: some columns newest, some newest non-null, some first non-null.

    An aggregate by key, so a repeated or late version changes nothing that a
    later sequence has set.  Columns outside the three lists count as newest.
    A value may be older than its row's newest version; with ``track`` its own
    sequence is kept beside it (SEQUENCES), which a table needs that is upserted
    again, so that versions find their place in whatever order they come.
    """
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    seq, known = F.col(sequence), SEQUENCES in rows.columns
    others = [c for c in rows.columns if c not in (key, sequence, SEQUENCES)]

    def of(c: str) -> Column:
        """The sequence of a value that is there."""
        own = F.coalesce(F.try_element_at(F.col(SEQUENCES), F.lit(c)), seq) if known else seq
        return F.when(F.col(c).isNotNull(), own)

    def newest(c: str) -> Column:
        # A struct is never null, so a null value of the newest version stands.
        return F.max_by(F.struct(F.col(c).alias("v")), seq)["v"].alias(c)

    aggs = [F.min_by(F.col(c), of(c)).alias(c) if c in FIRST else F.max_by(F.col(c), of(c)).alias(c) if c in FILLED else newest(c) for c in others]
    kept = [c for c in others if c in FIRST or c in FILLED]
    if track and kept:
        aggs.append(F.create_map(*(x for c in kept for x in (F.lit(c), (F.min if c in FIRST else F.max)(of(c))))).alias(SEQUENCES))
    out = rows.groupBy(key).agg(F.max(seq).alias(sequence), *aggs)
    return out.select(*(c for c in rows.columns if c != SEQUENCES), *([SEQUENCES] if track and kept else []))


def export_rows(notices: DataFrame) -> DataFrame:
    """Array columns as joined strings."""
    return notices.select(*(F.array_join(c, SEPARATOR).alias(c) if t.startswith("array") else F.col(c) for c, t in notices.dtypes))


#: Names that stand for no supplier.
PLACEHOLDERS = ("not awarded", "n/a", "tbc", "unknown", "various", "redacted")


def supplier_shares(notices: DataFrame, cap: float = 500_000_000) -> DataFrame:
    """Per supplier named on notices: notices, value (capped, then divided by all names given), active ones.

    Placeholders are dropped after the division.
    """
    names = F.filter(F.transform(F.split("supplier_names", r"\|"), lambda n: F.trim(n)), lambda n: n != "")
    rows = notices.where("supplier_names IS NOT NULL").withColumn("_names", names).where("size(_names) > 0")
    rows = rows.select("ocid", "status", "cpv_division", (F.least(F.col("value_amount").cast("double"), F.lit(cap)) / F.size("_names")).alias("part"), F.explode("_names").alias("name"))
    rows = rows.where(~F.lower("name").isin(*PLACEHOLDERS)).withColumn("name", F.initcap("name"))
    return rows.groupBy("name").agg(F.count("*").alias("notices"), F.round(F.coalesce(F.sum("part"), F.lit(0.0)), 4).alias("value"), F.count_if(F.col("status") == "active").alias("active"), F.count_distinct("cpv_division").alias("divisions"))


def rollup_classes(notices: DataFrame) -> DataFrame:
    """Per layer and sublayer, with layer totals (sublayer NULL)."""
    pipeline = F.col("status").isin("planned", "planning")
    return notices.where("layer IS NOT NULL").rollup("layer", "sublayer").agg(F.count("*").alias("notices"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(pipeline).alias("pipeline")).where("layer IS NOT NULL")


def buyers(notices: DataFrame, as_of: Column, by: str = "value", n: int = 20) -> DataFrame:
    """Top buyers by value or by notices."""
    open_ = tender_state(as_of) == "open"
    agg = notices.groupBy("buyer_name").agg(F.count("*").alias("notices"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"), F.count_distinct("cpv_division").alias("divisions"), F.min("published_date").alias("first_seen"), F.max("published_date").alias("last_seen"), F.count_if(open_).alias("open"))
    return agg.orderBy(F.desc(by), "buyer_name").limit(n)


def buyer_divisions(notices: DataFrame, top: DataFrame) -> DataFrame:
    """A32."""
    return notices.join(top.select("buyer_name"), "buyer_name", "left_semi").groupBy("buyer_name", "cpv_division").agg(F.count("*").alias("notices"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"))


def divisions(notices: DataFrame, years: list[int]) -> DataFrame:
    """Per CPV division, with counts per year as columns."""
    v = F.col("value_amount")
    year = [F.count_if(F.year("published_date") == y).alias(f"y{y}") for y in years]
    return notices.groupBy("cpv_division").agg(F.count("*").alias("notices"), F.count(v).alias("with_value"), F.coalesce(F.sum(v), F.lit(0)).cast("double").alias("value"), F.round(F.avg(F.when(v > 0, v.cast("double"))), 4).alias("average"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "complete").alias("awarded"), *year)


def tender_kpis(notices: DataFrame, as_of: Column, soon_days: int = 14) -> DataFrame:
    """A34 + F13."""
    state = tender_state(as_of)
    soon = (state == "open") & (F.col("tender_end_date") <= F.date_add(as_of, soon_days))
    return notices.agg(F.count("*").alias("notices"), F.count_if(F.coalesce(state == "open", F.lit(False))).alias("open"), F.count_if(F.coalesce(state == "pipeline", F.lit(False))).alias("pipeline"), F.count_if(F.coalesce(soon, F.lit(False))).alias("closing_soon"), F.coalesce(F.sum(F.when(state == "open", F.col("value_amount"))), F.lit(0)).cast("double").alias("open_value"))


def vendor_links(notices: DataFrame, text: Column, rules: dict[str, list[str]]) -> DataFrame:
    """(vendor, ocid), one row a vendor and notice."""
    from ledgerlake.operators.match import tags

    return notices.select(F.explode(tags(text, rules)).alias("vendor"), "ocid")


def vendor_totals(notices: DataFrame, links: DataFrame) -> DataFrame:
    """A35 + J15."""
    return links.join(notices, "ocid").groupBy("vendor").agg(F.count("*").alias("notices"), F.coalesce(F.sum("value_amount"), F.lit(0)).cast("double").alias("value"), F.count_if(F.col("status") == "active").alias("active"))


def counts(notices: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent values."""
    return notices.groupBy(by).agg(F.count("*").alias("notices")).orderBy(F.desc("notices"), by).limit(n)


#: Words of a body's name that don't tell it from another.
BODY_WORDS = ("the", "of", "council", "city", "borough", "county", "district", "metropolitan", "london", "royal", "unitary", "authority", "corporation")


def body_key(name: Column) -> Column:
    """A body's name without case, accents, signs and BODY_WORDS, its words in order; '' where nothing is left."""
    plain = F.regexp_replace(F.replace(strip_accents(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " ")
    return F.array_join(F.filter(F.split(F.trim(plain), " "), lambda w: ~w.isin(*BODY_WORDS)), " ")


def resolve_areas(notices: DataFrame, config: DataFrame, aliases: DataFrame) -> DataFrame:
    """``notices`` with buyer_lad_code, the area that the buyer's name stands for.

    A name's key (``body_key``) may be that of an alias (alias, lad_code), else that of
    an organisation; a key that stands for several areas, or none, leaves NULL.
    Distinct names are resolved, then joined back.
    """

    def codes(rows: DataFrame, name: str, to: str) -> DataFrame:
        keyed = rows.where("lad_code <> ''").select(body_key(F.col(name)).alias("_key"), "lad_code").where("_key <> ''")
        return keyed.groupBy("_key").agg(F.min("lad_code").alias("_low"), F.max("lad_code").alias("_high")).select("_key", F.struct(F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("code")).alias(to))

    names = notices.select("buyer_name").where("buyer_name IS NOT NULL").distinct().withColumn("_key", body_key(F.col("buyer_name")))
    found = names.join(small(codes(aliases, "alias", "_alias")), "_key", "left").join(small(codes(config, "council", "_own")), "_key", "left")
    # An alias that is ambiguous is not made up for by a like-named organisation.
    code = F.when(F.col("_alias").isNotNull(), F.col("_alias.code")).otherwise(F.col("_own.code"))
    return notices.join(found.select("buyer_name", code.alias("buyer_lad_code")), "buyer_name", "left")


def area_profile(notices: DataFrame) -> DataFrame:
    """Per buyer's area its technology notices: how many, their value, the first and the last day."""
    rows = notices.where(F.col("buyer_lad_code").isNotNull() & F.col("cpv_division").isin(*TECH_CPV))
    return rows.groupBy("buyer_lad_code").agg(F.count("*").alias("notices"), F.sum("value_amount").cast("double").alias("value"), F.min("published_date").alias("earliest"), F.max("published_date").alias("latest"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; ``order`` has to end in a unique key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
