"""Resolving not-modified revisits of a web archive.

A revisit record says that a server answered "not modified": its content is that of an earlier full response. Each
revisit takes the latest earlier full response of the same canonical URL (an as-of join), the validators of both are
compared, and the response's headers are updated by those that a not-modified answer may carry.

The join sorts narrow rows by URL and time into ranges, so that the captures of one URL may lie in many tasks. Inside a
range a running last value finds the response; rows before the first response of their URL in a range take the last one
of the ranges before, of which there is one row for each URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.llm.common import pick, stage

#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no other content.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, ``www.``, default port, index page, closing slash and tracking parameters go; host in lower case, parameters in order."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/index\\.html?$", "/"), "/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit("")))


def _lower(headers: Column) -> Column:
    """Header names in lower case; of repeated ones the first value."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e.key))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e.key == k), 1).value))


def _etag(c: Column) -> Column:
    """Weak comparison of entity tags looks past the mark of weakness."""
    return F.regexp_replace(F.trim(c), "^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row for each revisit record.

    ``records`` has record_id, url, captured (any ordered type), kind (``response`` or ``revisit``), status and headers
    (map of text to text). Full responses have kind ``response`` and status 200. Returns record_id, canonical_url,
    captured, response_id, response_captured, outcome and headers. Outcomes: ``resolved`` (the entity tags are equal
    under weak comparison or, without one in the revisit, the last-modified dates are), ``changed`` (they differ or the
    response has none), ``unvalidated`` (the revisit carries no validator) and ``missing`` (no earlier response). Only
    resolved revisits have headers: those of the response, in lower case, with the permitted ones of the revisit.
    A response at the same moment isn't earlier; of several at one moment the largest record_id counts. A null URL or
    time finds nothing; null headers are none; repeated rows are resolved one by one; an empty table gives an empty
    result; extra columns are dropped.
    """
    rows = pick(records, record_id=("record_id", "long"), url=("url", "string"), captured="captured", kind=("kind", "string"), status=("status", "int"), headers=("headers", "map<string,string>"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("captured").isNotNull()
    rows = rows.where(full | (F.col("kind") == "revisit")).withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("full", F.coalesce(full, F.lit(False)))
    usable = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    lost = rows.where(~usable & ~F.col("full"))
    order = ["captured", "full", "record_id"]  # of one moment, revisits come first
    ranged = rows.where(usable).repartitionByRange("canonical_url", *order).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged.select("part", "canonical_url", *order, _lower(F.col("headers")).alias("headers")), "captures")

    response = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), "captured", "headers"))
    before = Window.partitionBy("part", "canonical_url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("response", F.last(response, ignorenulls=True).over(before)).where(~F.col("full"))

    many = ranged.groupBy("canonical_url").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("canonical_url")
    tails = ranged.join(many.hint("merge"), "canonical_url", "left_semi").groupBy("canonical_url", "part").agg(F.max_by(response, F.when(F.col("full"), F.struct("captured", "record_id"))).alias("tail"))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("canonical_url", "part", F.last("tail", ignorenulls=True).over(earlier).alias("carried"))
    found = found.join(carried.hint("merge"), ["canonical_url", "part"], "left").withColumn("response", F.coalesce("response", "carried"))

    tag, stored = F.col("headers").getItem("etag"), F.col("response.headers").getItem("etag")
    date, stored_date = F.col("headers").getItem("last-modified"), F.col("response.headers").getItem("last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(_etag(tag) == _etag(stored), F.lit(False))).when(date.isNotNull(), F.coalesce(F.trim(date) == F.trim(stored_date), F.lit(False)))
    outcome = F.when(F.col("response").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("response.headers", lambda k, v: ~F.map_contains_key(allowed, k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(kept, allowed))
    out = found.withColumn("outcome", outcome).select("record_id", "canonical_url", "captured", F.col("response.id").alias("response_id"), F.col("response.captured").alias("response_captured"), "outcome", merged.alias("headers"))
    none = lost.select("record_id", "canonical_url", "captured", F.lit(None).cast("long").alias("response_id"), F.lit(None).cast(rows.schema["captured"].dataType).alias("response_captured"), F.lit("missing").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionByName(none)
