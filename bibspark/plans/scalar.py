"""Scalar normalisers, reading order, pending requests, tombstones and candidate order over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import library, reconstruct, resolve
from ..sources import table
from .more import _SCORED, jon12_scored
from .relational import _REV, revised


def sem16_urls(spark, sf_dir):
    """Host, path and query of absolute http(s) addresses; others are left out."""
    u = table(spark, sf_dir, "pages").select("page_id", F.trim("url").alias("url")).where(F.col("url").rlike(r"^(?i:https?)://[^/\s]+"))
    part = lambda name: F.try_parse_url("url", F.lit(name))
    return u.select("page_id", F.lower(part("HOST")).alias("host"), F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/")).alias("path"), part("QUERY").alias("query"))


def sem14_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("d"))
    issn = F.concat(F.lit("issn "), F.substring("d", 1, 3), F.lit(" "), F.substring("d", 4, 4), F.lit("x"))
    return p.select("p_partkey", N.issn(issn).alias("issn"), N.isbn(F.concat(F.lit("978-"), "d", F.lit("-X"))).alias("isbn"))


def sem10_dates(spark, sf_dir):
    """Partial dates from what an entry would say: year, month by number or name, nothing where they can't be read."""
    k = F.col("o_orderkey")
    when = F.col("o_orderdate")
    month = F.when(k % 3 == 0, F.date_format(when, "MMMM")).when(k % 3 == 1, F.date_format(when, "M")).otherwise(F.lit("13"))
    year = F.when(k % 5 == 0, "n.d.").otherwise(F.date_format(when, "yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.year(year).alias("year"), N.month(month).alias("month"))


def sem29_display(spark, sf_dir):
    t = F.concat(F.lit("{"), F.upper(F.substring("p_name", 1, 1)), F.lit("}"), F.substring("p_name", 2, 100), F.lit("  \\{x\\}\n y"))
    return table(spark, sf_dir, "part").select("p_partkey", N.title_for_display(t).alias("title"))


def win09_after_title(spark, sf_dir):
    """The seven blocks after the first title block of each page in reading order; blocks without an order come last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 1000).alias("ord"))
    reading = Window.partitionBy("page").orderBy(F.asc_nulls_last("ord"), "event_id")
    placed = e.withColumn("place", F.row_number().over(reading))
    titled = placed.withColumn("title", F.min(F.when(F.col("event_type") == "signup", F.col("place"))).over(Window.partitionBy("page")))
    return titled.where((F.col("place") > F.col("title")) & (F.col("place") <= F.col("title") + 7)).select("page", "event_id", (F.col("place") - F.col("title")).alias("after"))


def str03_pending(spark, sf_dir):
    """Consuming requests: ok if the user's last request was made within ten days and not consumed since, expired if earlier, else unknown."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.struct("event_type", "ts")).over(past)
    made = last["event_type"] == "signup"
    status = F.when(~F.coalesce(made, F.lit(False)), "unknown").when(last["ts"] + F.expr("interval 10 days") >= F.col("ts"), "ok").otherwise("expired")
    return e.withColumn("status", status).where("event_type = 'purchase'").select("event_id", "status")


def er20_concepts(spark, sf_dir):
    """Up to eight candidate words of a title: four letters or more, no stop words, in order."""
    tokens = F.filter(resolve.tokens(F.col("p_name"), 4), lambda w: ~w.isin("with", "from", "that", "using"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(tokens, 1, 8), ",").alias("concepts"))


def lib06_tombstones(spark, sf_dir):
    """References whose last event deleted them, with the revision that a restore would bring back."""
    rows = revised(spark, sf_dir)
    head = library.heads(rows).select("reference_id", F.col("latest_revision").alias("revision"))
    return rows.join(head, ["reference_id", "revision"]).where("action = 'delete'").select("reference_id", (F.col("revision") - 1).alias("restorable"))


def agg02_count(spark, sf_dir):
    return library.history(revised(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reference_id"))).agg(F.count("*").alias("n"))


def srt05_candidates(spark, sf_dir):
    return reconstruct.ranked(jon12_scored(spark, sf_dir)).select("ref_id", "record_id", "rank", "status")


QUERIES = {
    "sem16_urls": sem16_urls, "sem14_numbers": sem14_numbers, "sem10_dates": sem10_dates, "sem29_display": sem29_display, "win09_after_title": win09_after_title, "str03_pending": str03_pending,
    "er20_concepts": er20_concepts, "lib06_tombstones": lib06_tombstones, "agg02_count": agg02_count, "srt05_candidates": srt05_candidates,
}
ORACLES = {
    "sem16_urls": r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages WHERE regexp_matches(url, '^(?i:https?)://[^/\s]+')",
    "sem14_numbers": "WITH d AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 7, '0') AS d FROM part) SELECT p_partkey, substring(d, 1, 3) || substring(d, 4, 1) || '-' || substring(d, 5, 3) || 'X' AS issn, '978' || d || 'X' AS isbn FROM d",
    "sem10_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 3 < 2 THEN month(o_orderdate)::INT END AS month FROM orders",
    "sem29_display": "SELECT p_partkey, regexp_replace(upper(p_name[1]) || p_name[2:] || ' {x} y', '\\s+', ' ', 'g') AS title FROM part",
    "win09_after_title": "WITH p AS (SELECT user_id AS page, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 <> 0 THEN event_id % 1000 END ASC NULLS LAST, event_id)::INT AS place FROM events), t AS (SELECT page, min(place) AS title FROM p WHERE event_type = 'signup' GROUP BY 1) SELECT page, event_id, place - title AS after FROM p JOIN t USING (page) WHERE place > title AND place <= title + 7",
    "str03_pending": "WITH e AS (SELECT *, lag(event_type) OVER w AS lt, lag(ts) OVER w AS la FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN lt IS DISTINCT FROM 'signup' THEN 'unknown' WHEN la + INTERVAL 10 DAY >= ts THEN 'ok' ELSE 'expired' END AS status FROM e WHERE event_type = 'purchase'",
    "er20_concepts": r"SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda x: length(x) >= 4 AND x NOT IN ('with', 'from', 'that', 'using')), ',') AS concepts FROM part",
    "lib06_tombstones": f"WITH {_REV} SELECT v.reference_id, revision - 1 AS restorable FROM v JOIN h ON v.reference_id = h.reference_id AND revision = latest_revision WHERE action = 'delete'",
    "agg02_count": f"WITH {_REV} SELECT count(*) AS n FROM h JOIN v ON h.reference_id = v.reference_id AND latest_revision = revision",
    "srt05_candidates": f"WITH {_SCORED} SELECT ref_id, record_id, row_number() OVER (PARTITION BY ref_id ORDER BY CASE source WHEN 'crossref' THEN 10 ELSE 40 END, score DESC, record_id)::INT AS rank, 'match' AS status FROM s",
}
