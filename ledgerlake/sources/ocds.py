"""Procurement releases in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators.notices import flatten_compiled, flatten_releases

_VALUE = "struct<amount: double, currency: string>"
_DOCUMENTS = "array<struct<documentType: string, url: string, description: string>>"
SCHEMA = f"""ocid string, date string, tag array<string>, description string, buyer struct<name: string>, planning struct<documents: {_DOCUMENTS}>,
tender struct<title: string, description: string, status: string, datePublished: string, value: {_VALUE}, classification: struct<id: string>, tenderPeriod: struct<endDate: string>, documents: {_DOCUMENTS}, items: array<struct<deliveryAddresses: array<struct<region: string>>>>>,
awards array<struct<status: string, value: {_VALUE}, suppliers: array<struct<name: string>>>>,
contracts array<struct<title: string, value: {_VALUE}>>, parties array<struct<name: string, roles: array<string>>>"""


def read_ocds(spark: SparkSession, path: str, flavour: str = "release", region: str = "") -> DataFrame:
    """Flat notices from release JSON (one object a line) or yearly compiled .jsonl.gz files."""
    raw = spark.read.schema(SCHEMA).json(path)
    return flatten_releases(raw) if flavour == "release" else flatten_compiled(raw, region)
