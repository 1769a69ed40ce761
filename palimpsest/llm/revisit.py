"""WARC revisit records of the "server not modified" kind, resolved to the response they stand for.

A revisit has no body: it says that the server answered 304.  It is resolved to the latest earlier full response of
the same canonical URL (an as-of join), if their validators agree, and its stored headers are the response's,
renewed by those of the 304 that may renew them.  The as-of step sees one narrow row for each URL and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import last_at_most, materialize

#: Headers that a 304 may renew in the stored response (fixed values of the HTTP standards).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = "utm_[a-z]+|fbclid|gclid|ref"
NOT_MODIFIED = "server-not-modified/?$"
BLOCK_ROWS = 50_000

_CANONICAL_STEPS = (
    ("^[ \\t]+|[ \\t]+$", ""), ("#.*$", ""), ("^[A-Za-z][A-Za-z0-9+.-]*://", ""), ("^(www|m)[.]", ""), (f"([?&])(({TRACKING})=[^&]*&)+", "$1"), (f"[?&]({TRACKING})=[^&]*$", ""),
    ("(/index)?[.]html?($|[?])", "$2"), ("/+($|[?])", "$1"), ("[?]$", ""),
)


def canonical_url(url: Column) -> Column:
    """The URL without scheme, leading ``www.`` or ``m.``, the page name ``index`` and the endings ``.html`` and ``.htm``,
    tracking parameters (``ref`` among them), fragment and closing slash; host in lower case.  The order of the other
    parameters, ports and percent signs stay as they are."""
    out = url
    for pattern, by in _CANONICAL_STEPS[:3]:
        out = F.regexp_replace(out, pattern, by)
    host = F.lower(F.regexp_extract(out, "^[^/?]*", 0))
    out = F.concat(host, F.regexp_replace(out, "^[^/?]*", ""))
    for pattern, by in _CANONICAL_STEPS[3:]:
        out = F.regexp_replace(out, pattern, by)
    return out


def canonical_sql(url: str) -> str:
    out = url
    for pattern, by in _CANONICAL_STEPS[:3]:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = f"(lower(regexp_extract({out}, '^[^/?]*', 0)) || regexp_replace({out}, '^[^/?]*', ''))"
    for pattern, by in _CANONICAL_STEPS[3:]:
        by = by.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of spellings that become equal the greatest stays."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve(records: DataFrame, only_304: bool = False) -> DataFrame:
    """Resolve the revisits among ``records``.

    Input columns (others are ignored): ``record_id`` long, ``url`` string, ``ts`` long, ``kind`` string (``response``
    or ``revisit``), ``status`` int, ``headers`` map of strings, ``body`` string, and if there is one ``profile`` string, the
    revisit profile.  Output, one row per record of either kind: ``record_id``, ``url_key``, ``ts``, ``kind``,
    ``outcome``, ``source_id``, ``body``, ``headers``.

    A full response has kind ``response`` and status 200 and a time; it is its own source (``full``).  Other responses
    are ``not-full``.  A revisit whose profile is given and is not "server not modified" is ``not-304`` and stays as it
    is; with ``only_304`` so is one with another status than 304 (null counts as 304).  Other revisits take the full response of their canonical URL with the
    greatest ``ts`` below their own (of equal times the greatest ``record_id``, null least, then the greatest hash of its
    content): ``resolved`` if the revisit names at least one validator (ETag, compared weakly, or Last-Modified) and each
    that both name is equal, with at least one in common; ``mismatch`` otherwise, with the source named but no body.
    ``unmatched``: no earlier response, or a null URL or time.  A source without an id resolves all the same, as null.
    Header names compare in lower case; of a header in several spellings the greatest by code point counts; each 304
    renews the headers of the stored response, not those that another 304 renewed.  Repeated records are resolved
    each.  Other kinds and null kinds are dropped.
    """
    spark, empty = records.sparkSession, F.create_map().cast("map<string,string>")
    profile = F.col("profile").cast("string") if "profile" in records.columns else F.lit(None).cast("string")
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind",
        (F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False)) & F.col("ts").isNotNull() & F.col("url").isNotNull()).alias("full"),
        ((F.col("kind") == "revisit") & (F.coalesce(F.col("status") == 304, F.lit(True)) | F.lit(not only_304)) & F.coalesce(F.lower(profile).rlike(NOT_MODIFIED), F.lit(True))).alias("asks"),
        F.coalesce(_lower_names(F.col("headers")), empty).alias("headers"), F.col("body").cast("string").alias("body"),
    )
    content = F.xxhash64("url_key", "ts", "record_id", "body", F.array_sort(F.map_entries("headers")))  # tells responses apart
    # a row for each URL and time, whatever the number of records that share them
    best = F.max(F.when(F.col("full"), F.struct("ts", "record_id", content.alias("content"))))
    thin = materialize(rows.filter("(full OR asks) AND url_key IS NOT NULL AND ts IS NOT NULL").groupBy("url_key", "ts").agg(best.alias("best"), F.bool_or("asks").alias("asked"), F.count_if("full").alias("n")), "times")
    blocks = max(1, -(-thin.count() // BLOCK_ROWS)) * 4
    edges = sorted(r["lo"] for r in thin.select("ts").repartitionByRange(blocks, "ts").groupBy(F.spark_partition_id().alias("g")).agg(F.min("ts").alias("lo")).collect())
    times = thin.withColumn("block", last_at_most(edges or [0], F.col("ts")))
    # as-of in two steps, so that one URL may fill the table: within a block of time (blocks have equally many rows), and from the blocks before
    ends = times.groupBy("url_key", "block").agg(F.max("best").alias("end"))
    carried = ends.select("url_key", "block", F.max("end").over(W.partitionBy("url_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    earlier = W.partitionBy("url_key", "block").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    found = times.withColumn("here", F.max("best").over(earlier)).filter("asked").join(carried, ["url_key", "block"])
    links = found.select(F.col("url_key").alias("l_key"), F.col("ts").alias("l_ts"), F.coalesce("here", "before").alias("source"))

    full = rows.filter("full").select(F.col("url_key").alias("s_key"), content.alias("s_content"), F.col("headers").alias("s_headers"), F.col("body").alias("s_body"))
    # many revisits may share one response: with both sides straight from an exchange their partition can be split
    if not thin.filter("n > 1").isEmpty():
        # responses of one URL and time: those that are equal in all count once
        crowded = thin.filter("n > 1").select(F.col("url_key").alias("c_key"), F.col("best.content").alias("c_content"))
        own = (full["s_key"] == crowded["c_key"]) & (full["s_content"] == crowded["c_content"])
        full = full.join(crowded, own, "left_anti").unionByName(full.join(crowded, own, "left_semi").dropDuplicates(["s_key", "s_content"]))
    revisits = rows.filter("kind = 'revisit'").select("record_id", "url_key", "ts", "kind", "headers", "asks")
    linked = revisits.join(links, F.col("asks") & (revisits["url_key"] == links["l_key"]) & (revisits["ts"] == links["l_ts"]), "left").drop("l_key", "l_ts")
    joined = linked.join(full, (linked["url_key"] == full["s_key"]) & (linked["source.content"] == full["s_content"]), "left").withColumn("source_id", F.col("source.record_id"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tags = weak(_header(F.col("headers"), "etag")) == weak(_header(F.col("s_headers"), "etag"))
    dates = _header(F.col("headers"), "last-modified") == _header(F.col("s_headers"), "last-modified")
    agree = F.coalesce(tags, dates, F.lit(False)) & F.coalesce(tags, F.lit(True)) & F.coalesce(dates, F.lit(True))
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("s_headers", lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)
    outcome = F.when(~F.col("asks"), "not-304").when(F.col("s_content").isNull(), "unmatched").when(agree, "resolved").otherwise("mismatch")
    done = joined.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "kind", "outcome", "source_id",
        F.when(F.col("outcome") == "resolved", F.col("s_body")).alias("body"), F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )
    own = rows.filter("kind = 'response'").select(
        "record_id", "url_key", "ts", "kind", F.when(F.col("full"), "full").otherwise("not-full").alias("outcome"), F.when(F.col("full"), F.col("record_id")).alias("source_id"), "body", "headers"
    )
    return own.unionByName(done)
