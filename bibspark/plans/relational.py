"""Library, history, configuration and event queries straight on the tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import library as L
from ..sources import table

START = datetime.datetime(1995, 1, 1)
_ACTION = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'restore' ELSE 'update' END"


def references(spark, sf_dir):
    k = F.col("p_partkey")
    updated = F.timestamp_seconds(F.lit(788918400) + (k % 5000) * 3600).cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("part"), k).alias("citation_key"), F.col("p_brand").alias("venue"), F.col("p_type").alias("entry_type"),
        F.when(k % 41 != 0, (1990 + k % 30).cast("int")).alias("year"), updated.alias("updated_at"),
    )


def contributors(spark, sf_dir):
    """(id, position, display_name): the distinct suppliers of a part's line items."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("position")).distinct()
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("display_name"))
    return pairs.join(names, "position").select("id", "position", "display_name")


_REFS = """r AS (SELECT p_partkey AS id, p_name AS title, 'part' || p_partkey AS citation_key, p_brand AS venue, p_type AS entry_type,
  CASE WHEN p_partkey % 41 <> 0 THEN (1990 + p_partkey % 30)::INT END AS year, TIMESTAMP '1995-01-01' + to_hours(p_partkey % 5000) AS updated_at FROM part)"""
_CONS = "c AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS position, s_name AS display_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def lib01_search(spark, sf_dir):
    found = L.search(references(spark, sf_dir), contributors(spark, sf_dir), query="7", author="#00000000", since=START)
    return found.select("id", "title", "year")


def lib01_filters(spark, sf_dir):
    return L.search(references(spark, sf_dir), year=1995, venue="brand").select("id", "venue", "year")


def lib01_identifier(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" 10.1000/P"), F.col("p_partkey") % 50).alias("value"))
    return L.search(references(spark, sf_dir), identifier="10.1000/p7", identifiers=ids).select("id", "title")


def lib02_page(mode):
    def query(spark, sf_dir):
        return L.page(references(spark, sf_dir), mode, 20, 50).select("id", "total")

    return query


def _page_sql(order):
    return f"WITH {_REFS} SELECT id, (SELECT count(DISTINCT id) FROM r) AS total FROM (SELECT id FROM r ORDER BY {order} LIMIT 50 OFFSET 20)"


def jon05_assembled(spark, sf_dir):
    return L.assembled(references(spark, sf_dir), contributors(spark, sf_dir)).select("id", "authors")


def revised(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("reference_id"), F.col("ts").alias("occurred_at"), F.expr(_ACTION).alias("action"), F.col("props").alias("snapshot"))
    return L.revisions(ev)


_REV = f"""v AS (SELECT event_id, user_id AS reference_id, ts AS occurred_at, {_ACTION} AS action, props AS snapshot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS revision FROM events),
  h AS (SELECT reference_id, max(revision) AS latest_revision, max(occurred_at) AS updated_at FROM v GROUP BY 1)"""


def win00_revisions(spark, sf_dir):
    return revised(spark, sf_dir).select("event_id", "reference_id", "revision")


def agg03_heads(spark, sf_dir):
    return L.heads(revised(spark, sf_dir))


def lib08_history(spark, sf_dir):
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("reference_id"))
    return L.history(revised(spark, sf_dir), live)


def jon13_without_head(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reference_id"))
    return L.without_head(refs, L.heads(revised(spark, sf_dir)))


def lib09_restore(spark, sf_dir):
    rows = revised(spark, sf_dir)
    head = L.heads(rows)
    asked = head.select("reference_id", (F.col("latest_revision") - F.col("reference_id") % 4).cast("int").alias("to_revision"), (F.col("latest_revision") - F.when(F.col("reference_id") % 5 == 0, 1).otherwise(0)).cast("int").alias("expected_head"))
    return L.restored(rows, asked)


def lib09_as_of(spark, sf_dir):
    return L.as_of(revised(spark, sf_dir), datetime.datetime(2024, 1, 15)).select("reference_id", "revision", "action")


def jon06_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select("c_custkey", "c_name")
    over = c.where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("my "), "c_name").alias("c_name"))
    custom = c.where("c_custkey % 10 = 3").select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))
    return L.overlay(base, over.unionByName(custom), ["c_custkey"], ["c_name"])


def jon04_creators(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def set02_delta(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    half = F.lit(datetime.datetime(2024, 1, 16))
    before, after = ev.where(F.col("ts") < half).select("user_id", "event_type").distinct(), ev.where(F.col("ts") >= half).select("user_id", "event_type").distinct()
    keys = ["user_id", "event_type"]
    return after.join(before, keys, "left_anti").withColumn("side", F.lit("added")).unionByName(before.join(after, keys, "left_anti").withColumn("side", F.lit("removed")))


def lib04_identities(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    stored = part.select(F.lit("doi").alias("scheme"), F.concat(F.lit("10.1000/"), F.col("p_partkey") % 500).alias("value"), F.col("p_partkey").alias("id")).where("id % 10 = 0")
    incoming = part.select(F.when(F.col("p_partkey") % 2 == 0, "doi").otherwise("isbn").alias("scheme"), F.concat(F.lit("10.1000/"), F.col("p_partkey") % 500).alias("value"), F.col("p_partkey").alias("id"))
    return L.taken_identities(incoming, stored).select("id", "held_by", "value")


def agg15_counters(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))
    return L.counters(ev, ["event_type", "status"], "value").select("event_type", "status", "n", "line")


def win02_latest(spark, sf_dir):
    return E.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def win03_trailing(spark, sf_dir):
    return E.trailing_count(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "recent")


def win04_cooldown(spark, sf_dir):
    return E.cooldown(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 7200).select("event_id", "rejected")


def str01_token_bucket(spark, sf_dir):
    return E.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1 / 86400, 2.0)


def str02_first_seen(spark, sf_dir):
    return E.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 86400)


_EV = "epoch_us(ts) AS t"
QUERIES = {
    "lib01_search": lib01_search, "lib01_filters": lib01_filters, "lib01_identifier": lib01_identifier, "lib02_page_updated": lib02_page("updated_desc"), "srt01_year_desc": lib02_page("year_desc"), "srt01_title": lib02_page("title_asc"),
    "jon05_assembled": jon05_assembled, "win00_revisions": win00_revisions, "agg03_heads": agg03_heads, "lib08_history": lib08_history, "jon13_without_head": jon13_without_head,
    "lib09_restore": lib09_restore, "lib09_as_of": lib09_as_of, "jon06_overlay": jon06_overlay, "jon04_creators": jon04_creators, "set02_delta": set02_delta, "lib04_identities": lib04_identities,
    "agg15_counters": agg15_counters, "win02_latest": win02_latest, "win03_trailing": win03_trailing, "win04_cooldown": win04_cooldown, "str01_token_bucket": str01_token_bucket, "str02_first_seen": str02_first_seen,
}
ORACLES = {
    "lib01_search": f"WITH {_REFS}, {_CONS} SELECT DISTINCT id, title, year FROM r LEFT JOIN c USING (id) WHERE (title ILIKE '%7%' OR citation_key ILIKE '%7%' OR venue ILIKE '%7%' OR coalesce(display_name ILIKE '%7%', false)) AND display_name ILIKE '%#00000000%' AND updated_at >= TIMESTAMP '1995-01-01'",
    "lib01_identifier": "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 50 = 7",
    "lib01_filters": f"WITH {_REFS} SELECT id, venue, year FROM r WHERE year = 1995 AND venue ILIKE '%brand%'",
    "lib02_page_updated": _page_sql("updated_at DESC NULLS LAST, id"),
    "srt01_year_desc": _page_sql("year DESC NULLS LAST, title ASC NULLS LAST, id"),
    "srt01_title": _page_sql("title ASC NULLS LAST, id"),
    "jon05_assembled": f"WITH {_REFS}, {_CONS}, a AS (SELECT id, string_agg(display_name, '; ' ORDER BY position) AS authors FROM c GROUP BY id) SELECT id, coalesce(authors, '') AS authors FROM r LEFT JOIN a USING (id)",
    "win00_revisions": f"WITH {_REV} SELECT event_id, reference_id, revision FROM v",
    "agg03_heads": f"WITH {_REV} SELECT * FROM h",
    "lib08_history": f"WITH {_REV} SELECT h.reference_id, latest_revision, updated_at, action, coalesce(c_acctbal > 0, false) AS live FROM h JOIN v ON h.reference_id = v.reference_id AND latest_revision = revision LEFT JOIN customer ON h.reference_id = c_custkey",
    "jon13_without_head": f"WITH {_REV} SELECT c_custkey AS reference_id, 0::INT AS latest_revision FROM customer WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.reference_id = c_custkey)",
    "lib09_restore": f"WITH {_REV}, q AS (SELECT reference_id, latest_revision, latest_revision - reference_id % 4 AS tr, latest_revision - (reference_id % 5 = 0)::INT AS eh FROM h), s AS (SELECT q.reference_id, tr::INT AS to_revision, CASE WHEN v.snapshot IS NULL THEN 'not_found' WHEN latest_revision <> eh THEN 'stale' ELSE 'ok' END AS status, latest_revision, v.snapshot FROM q LEFT JOIN v ON q.reference_id = v.reference_id AND v.revision = q.tr) SELECT reference_id, to_revision, status, CASE WHEN status = 'ok' THEN latest_revision + 1 END AS new_revision, CASE WHEN status = 'ok' THEN snapshot END AS snapshot FROM s",
    "lib09_as_of": f"WITH {_REV} SELECT reference_id, revision, action FROM v WHERE occurred_at <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY revision DESC) = 1",
    "jon06_overlay": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'my ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 'override' ELSE 'built_in' END AS origin FROM customer UNION ALL SELECT c_custkey + 1000000000, 'new ' || c_name, 'custom' FROM customer WHERE c_custkey % 10 = 3",
    "jon04_creators": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "set02_delta": "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16') SELECT *, 'added' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "lib04_identities": "SELECT i.p_partkey AS id, s.p_partkey AS held_by, '10.1000/' || (i.p_partkey % 500) AS value FROM part i JOIN part s ON i.p_partkey % 500 = s.p_partkey % 500 AND s.p_partkey % 10 = 0 AND i.p_partkey % 2 = 0 AND i.p_partkey <> s.p_partkey",
    "agg15_counters": "SELECT event_type, status, n, 'requests_total{event_type=\"' || event_type || '\",status=\"' || status || '\"} ' || n AS line FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::INT AS status, count(*) AS n FROM events GROUP BY 1, 2)",
    "win02_latest": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "win03_trailing": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT *, {_EV} FROM events)",
    "win04_cooldown": f"SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000, false) AS rejected FROM (SELECT *, {_EV} FROM events)",
    "str02_first_seen": f"""WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, {_EV}, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, event_type, event_id, n, t AS last, true AS fresh FROM o WHERE n = 1 UNION ALL
            SELECT o.user_id, o.event_type, o.event_id, o.n, CASE WHEN o.t - f.last >= 86400000000 THEN o.t ELSE f.last END, o.t - f.last >= 86400000000 FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.n = f.n + 1)
      SELECT user_id, event_type, event_id, fresh FROM f""",
    "str01_token_bucket": f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_EV}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, t, 2.0::DOUBLE AS had FROM o WHERE n = 1 UNION ALL
            SELECT o.user_id, o.event_id, o.n, o.t, least(2.0::DOUBLE, f.had - (f.had >= 1)::INT + (o.t - f.t) / 1e6::DOUBLE * (1.0::DOUBLE / 86400.0::DOUBLE)) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
      SELECT event_id, user_id, had >= 1 AS allowed, CASE WHEN had >= 1 THEN 0 ELSE ceil((1 - had) / (1.0::DOUBLE / 86400.0::DOUBLE)) END::BIGINT AS retry_after FROM f""",
}
