"""Queries over stored records, edits of sources, providers, layouts and feeds; rows are derived from `part`, `customer` and `events`, the SQL tells them from the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing, fixes, library, parse, policy, reconstruct, records, rules, semantic
from ..sources import rich, table
from .bibtex import BASE, _entries
from .more import _SCORED
from .rich import K

k = lambda: F.col("c_custkey")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def _audit(spark, sf_dir):
    """Audit events of references: snapshots of the second and of the first version, without data, and deletions."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.concat(F.lit("@misc{e"), i, F.lit("}"))
    after = F.when(i % 5 == 0, F.to_json(F.struct(F.lit(2).alias("version"), F.concat(F.lit("T"), i).alias("title"), body.alias("bibtex")))).when(i % 5 == 1, F.to_json(F.struct(F.lit(" ").alias("title"), body.alias("raw_bibtex")))).when(i % 5 == 2, F.lit('{"title":"only"}'))
    before = F.when(i % 2 == 0, F.to_json(F.struct(F.concat(F.lit("B"), i).alias("title"), body.alias("raw_bibtex"))))
    return e.select(F.col("user_id").alias("reference_id"), "event_id", F.col("ts").alias("occurred_at"), after.alias("after_data"), before.alias("before_data"), F.when(i % 5 == 3, "delete").otherwise("update").alias("action"))


def lib12_revisions(spark, sf_dir):
    return records.projected(library.revisions(_audit(spark, sf_dir)))


def lib11_snapshots(spark, sf_dir):
    s = records.snapshot(F.col("after_data"))
    return _audit(spark, sf_dir).select("event_id", s["version"].alias("version"), s["bibtex"].alias("bibtex"), s["complete"].alias("complete"))


def lib10_baselines(spark, sf_dir):
    revised = library.revisions(_audit(spark, sf_dir))
    head = revised.join(library.heads(revised).select("reference_id", F.col("latest_revision").alias("revision")), ["reference_id", "revision"])
    return records.baselines(head)


def lib15b_actions(spark, sf_dir):
    action, kept = records.audit_action(F.col("before_data"), F.col("after_data"))
    return _audit(spark, sf_dir).groupBy(action.alias("action"), kept.isNull().alias("lost")).agg(F.count("*").alias("n"))


def lib03_get(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("c_custkey"))
    return records.get(_customers(spark, sf_dir), wanted, "c_custkey").select("c_custkey", "c_name")


def lib07_contexts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("reference_id"), F.col("ts").alias("at"), F.col("event_id").alias("ident"), F.col("event_type").alias("text"))
    return records.with_contexts(_customers(spark, sf_dir).select(k().alias("reference_id"), F.lit(1).alias("revision")), e)


def lib15_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    opened = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("created"), (F.col("ts") + F.expr("interval 7 days")).alias("expires"), F.when(F.col("event_id") % 9 == 0, F.col("ts") + F.expr("interval 1 day")).alias("revoked"))
    off = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("disabled_at"))
    return records.session_status(opened, off, F.lit("2024-01-25").cast("timestamp_ntz"), "10 days")


def srt04_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), F.date_trunc("day", "ts").alias("occurred_at"), F.col("event_id").alias("revision"))
    return records.setting_history(rows).select("kind", "revision", "place")


def lib14_registry(spark, sf_dir):
    """Venue kinds of the corpus under a registry with stored settings laid over it."""
    base = spark.createDataFrame([("journal of parts", "jop", "journal"), ("venue 1", "v1", "journal")], "alias string, venue_id string, kind string")
    stored = spark.createDataFrame([("venue 1", "v1", "conference"), ("venue 2", "own2", "workshop")], "alias string, venue_id string, kind string")
    registry = library.overlay(base, stored, ["alias"], ["venue_id", "kind"]).withColumn("ord", F.lit(0))
    return policy.with_venue_kind(semantic.records(_entries(spark, sf_dir)), registry).where("kind is not null").select("doc_id", "entry_idx", "venue_id", "kind")


def jon09_by_provider(spark, sf_dir):
    from .more import jon12_scored

    return reconstruct.best_by_provider(jon12_scored(spark, sf_dir)).select("ref_id", "source", "record_id")


def er22_providers(spark, sf_dir):
    refs = _customers(spark, sf_dir).select(k().alias("ref_id"), F.when(k() % 4 == 0, F.concat(F.lit("see arXiv: 2001."), F.lpad((k() % 100000).cast("string"), 5, "0"))).when(k() % 4 == 1, "https://arxiv.org/abs/x").otherwise(F.col("c_name")).alias("text"))
    return reconstruct.providers_to_ask(refs, spark.createDataFrame([("crossref", 0), ("arxiv", 1), ("local", 2)], "source string, ord int")).select("ref_id", "source")


def srt06_queries(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ref_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", "arXiv query").otherwise(F.col("event_type")).alias("text"))
    return reconstruct.prioritised(e).select("ref_id", "ord", "place")


def srt07_details(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ref_id"), F.col("event_id").alias("record_id"), F.round(F.col("event_id") % 101 / 100, 2).alias("score"))
    return reconstruct.details_to_fetch(e).select("ref_id", "record_id", F.col("place").cast("long").alias("place"))


def er12_evidence(spark, sf_dir):
    rows = _customers(spark, sf_dir).select(k(), F.concat(F.lit("10.1/"), k()).alias("wanted_doi"), F.when(k() % 5 != 0, F.concat(F.lit("10.1/"), k() + (k() % 3 == 0).cast("int"))).alias("doi"), F.when(k() % 4 != 0, F.col("c_name")).alias("title"), ((k() % 10) / 10).alias("t"))
    return reconstruct.evidence(rows).select("c_custkey", "accepted", "reason")


def er23_local(spark, sf_dir):
    c = lambda n, m: F.when(k() % n == m, F.concat(F.lit("10.1/"), k()))
    rows = _customers(spark, sf_dir).select(k(), c(3, 0).alias("doi"), F.when(k() % 6 == 0, F.concat(F.lit("10.1/"), k() + 1)).otherwise(c(3, 0)).alias("r_doi"), ((k() % 11) / 10).alias("t"), F.lit("Ann Lee").alias("authors"), F.when(k() % 7 == 0, "Bob Ray").otherwise("Lee").alias("r_authors"), F.lit(2000).alias("year"), F.when(k() % 13 == 0, 2001).alias("r_year"))
    return rows.where(reconstruct.local_match(rows)).select("c_custkey")


def er16_final(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return reconstruct.first_final(e.select(F.col("user_id").alias("ref_id"), i.alias("ord"), (i % 4 == 0).alias("accepted"), (i % 3 != 0).alias("complete"), (i % 17 == 0).alias("conflict")))


def er15_synthesis(spark, sf_dir):
    types = F.when(k() % 4 == 0, F.array(F.lit("Journal Article"))).when(k() % 4 == 1, F.array(F.lit("journal-article"), F.lit("book"))).when(k() % 4 == 2, F.array(F.lit("Conference"), F.lit("proceedings-article"), F.lit("Review"))).otherwise(F.array(F.lit("Review")))
    rows = _customers(spark, sf_dir).select(k().alias("id"), F.lit("crossref").alias("source"), F.col("c_name").alias("title"), F.when(k() % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"))).alias("authors"), F.when(k() % 14 != 0, 2000).alias("year"), F.when(k() % 6 != 0, "Proceedings of Natural Language Processing").alias("venue"), F.when(k() % 8 == 0, "Zoology Letters").when(k() % 8 == 2, "PNLP").otherwise("natural language processing").alias("wanted_venue"), types.alias("types"))
    return records.synthesized(rows)


def er18_clues(spark, sf_dir):
    refs = _customers(spark, sf_dir).select(k().alias("ref_id"), F.when(k() % 2 == 0, "own").otherwise(" ").alias("title"), F.lit(None).cast("string").alias("year"))
    return records.with_clues(refs, refs.where("ref_id % 3 = 0").select("ref_id", F.lit("found").alias("title"), F.lit("2001").alias("year")), ("title", "year"))


def er20_titles(spark, sf_dir):
    title = F.concat(F.initcap("c_mktsegment"), F.when(k() % 2 == 0, ": A Study of NLP with BERTs and ").otherwise(" and the Use of "), F.lower("c_mktsegment"), F.lit(" tools"))
    got = records.concepts(title)
    return _customers(spark, sf_dir).select(k(), F.array_join(got, ",").alias("concepts"), records.representative(got, F.array(F.lower("c_mktsegment"))).alias("concept"))


def er24_pickers(spark, sf_dir):
    text = lambda lang, t: F.struct(F.lit(lang).alias("lang"), t.alias("text"))
    p = records.picked(F.array(F.lit(" "), F.col("c_name")), F.array(F.lit(2000) + k() % 9, F.lit(5)), F.when(k() % 2 == 0, F.array(text("ja", F.lit("x")), text("en", F.lit("y")))).otherwise(F.array(text("ja", F.lit("x")))), F.array(F.lit("ja"), F.when(k() % 3 == 0, "ja").otherwise("en"), F.lit("en")))
    return _customers(spark, sf_dir).select(k(), p.alias("p")).select("c_custkey", "p.*")


def _layout(spark, sf_dir):
    """An OCR result for each customer: title, names, an affiliation, an abstract, under either set of keys."""
    block = lambda order, label, text: F.struct(F.lit(label).alias("block_label"), text.alias("block_content"), F.lit(order).alias("block_order"), F.lit(order).alias("block_id"))
    blocks = F.array(block(2, "text", F.concat(F.lit("Ann "), F.lit("Lee"), k() % 7, F.lit(", Bob Ray and Cy Day"))), block(1, "doc_title", F.concat(F.lit("On  Case "), k())), block(3, "text", F.lit("University of X, a@b.org")), block(4, "text", F.concat(F.lit("Abstract: We study case "), k())), block(5, "text", F.lit("Intro, Body")))
    page = F.array(F.struct(F.lit(1).alias("page"), blocks.alias("blocks")))
    return _customers(spark, sf_dir).select(k().alias("doc_id"), F.when(k() % 2 == 0, F.to_json(F.struct(page.alias("pages")))).otherwise(F.to_json(F.struct(page.alias("results")))).alias("payload"))


def src05_layout(spark, sf_dir):
    return _layout(spark, sf_dir).select("doc_id", F.explode(records.artifact(F.col("payload"))).alias("b")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("b.block_order").alias("last"))


def tx13_layout(spark, sf_dir):
    return records.layout(_layout(spark, sf_dir).select("doc_id", F.explode(records.artifact(F.col("payload"))).alias("b")).select("doc_id", "b.*"))


def src11_feed(spark, sf_dir):
    entry = F.concat(F.lit("<entry><id>urn:"), k(), F.lit("</id><title type='html'>A &lt;b&gt; <i>of</i>\n "), "c_mktsegment", F.lit("</title><author><name>Ann</name></author><author><name>B &amp; C</name></author></entry>"))
    xml = F.concat(F.when(k() % 5 == 0, "<!DOCTYPE x>").otherwise(""), F.lit("<feed>"), entry, F.when(k() % 2 == 0, entry).otherwise(""), F.lit("</feed>"))
    rows = _customers(spark, sf_dir).select(k(), F.explode(records.feed_entries(xml)).alias("x"))
    return rows.groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("x.title").alias("title"), F.max(F.array_join("x.authors", "; ")).alias("authors"))


def tx05_unnumbered(spark, sf_dir):
    line = F.when(k() % 3 == 0, F.concat(F.lit("Lee, Ann. "), 1990 + k() % 30, F.lit(". On case."))).when(k() % 3 == 1, F.concat(F.lit("Ray and Day ("), 1990 + k() % 30, F.lit(") Case."))).otherwise(F.lit("and goes on in lower case, 1999."))
    return _customers(spark, sf_dir).where(records.unnumbered_starts(line)).select("c_custkey")


def tx15_repair(spark, sf_dir):
    stored = _customers(spark, sf_dir).select(k().alias("ref_id"), F.when(k() % 2 == 0, "t").otherwise("").alias("title"), F.when(k() % 3 == 0, "J, 2001, pp. 3").otherwise("J").alias("venue"))
    return records.repaired(stored, stored.where("ref_id % 5 <> 0").select("ref_id", F.lit("new t").alias("title"), F.lit("New J").alias("venue")), ("title", "venue"))


def tx15_merged(spark, sf_dir):
    text = F.concat(F.lit("[1] First reference here "), k(), F.when(k() % 2 == 0, " [2] Second reference here").otherwise(""), F.lit(" [3] short"))
    return _customers(spark, sf_dir).select(k(), F.size(records.split_merged(text)).alias("n"))


def snk04_summaries(spark, sf_dir):
    forms = F.array(*[F.struct(F.lit(f).alias("form"), records.summary_text(F.concat(F.lit('On "'), k(), F.lit('"')), F.col("c_mktsegment"), k() % 9, f).alias("text")) for f in ("json", "csv", "markdown", "text")])
    return _customers(spark, sf_dir).select(k(), F.explode(forms).alias("x")).select("c_custkey", "x.*")


def exp19_rendered(spark, sf_dir):
    rows = _customers(spark, sf_dir).select(k(), F.concat(F.lit(" T"), k()).alias("title"), F.when(k() % 2 == 0, 2000).alias("year"), F.lit("").alias("doi"))
    return rows.select("c_custkey", editing.rendered(rows, F.concat(F.lit("c"), k()), F.lit("misc"), ("title", "year", "doi")).alias("bibtex"))


def par13_utf16(spark, sf_dir):
    text = F.concat(F.lit("ab"), F.lit("é🙂"), F.lit("z"))
    return _customers(spark, sf_dir).select(k(), editing.utf16_index(text, (k() % 12).cast("int")).alias("at"))


def par14_inspect(spark, sf_dir):
    e = parse.entries(parse.blocks(rich.documents(spark, sf_dir)))
    j = editing.inspected()
    return e.select("doc_id", "entry_idx", F.get_json_object(j, "$.citation_key").alias("key"), F.get_json_object(j, "$.fields[0].name").alias("name"), F.size(F.from_json(F.get_json_object(j, "$.fields"), "array<struct<name:string>>")).alias("n"))


def _changed(spark, sf_dir, edits):
    docs = rich.documents(spark, sf_dir)
    return parse.blocks(fixes.apply(docs, edits(parse.entries(parse.blocks(docs)))))


def fix11_new_keys(spark, sf_dir):
    after = _changed(spark, sf_dir, lambda e: editing.new_keys(e, e.select("doc_id", "entry_idx", F.concat(F.lit("new:"), F.upper("citation_key")).alias("key"))))
    return parse.entries(after).select("doc_id", "entry_idx", "citation_key", F.size("fields").alias("n"))


def _supplements(e):
    row = lambda source, name, value, where: e.where(where).select("doc_id", "entry_idx", F.lit(source).alias("source"), F.lit(name).alias("name"), F.lit(value).alias("value"))
    two = row("b", "series", "S", "entry_idx % 4 = 3")
    return row("a", "Publisher", "Press", "true").unionByName(row("a", "author", "Filled, In", "true")).unionByName(row("a", "keywords", "no", "true")).unionByName(two)


def fix10_filled(spark, sf_dir):
    after = parse.entries(_changed(spark, sf_dir, lambda e: editing.filled(e, _supplements(e))))
    return after.select("doc_id", "entry_idx", semantic.first("publisher")["resolved"].alias("publisher"), F.coalesce(semantic.first("author")["resolved"] == "Filled, In", F.lit(False)).alias("filled"), semantic.first("keywords").isNull().alias("portable"))


def fix08_canonical(spark, sf_dir):
    docs = rich.documents(spark, sf_dir)
    fixed = fixes.fixed_point(docs)
    before = parse.blocks(docs)
    good = editing.canonical(docs, fixed, before, parse.blocks(fixed)).select("doc_id", F.col("kept").alias("fixed_kept"))
    other = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("source", "Study of Case", "Case")).otherwise(F.col("source")).alias("source"))
    return good.join(editing.canonical(docs, other, before, parse.blocks(other)).select("doc_id", F.col("kept").alias("other_kept")), "doc_id")


def fix09_delta(spark, sf_dir):
    docs = rich.documents(spark, sf_dir)
    of = lambda d: rules.in_entries(parse.entries(parse.blocks(d)))
    changed = editing.delta(of(docs), of(fixes.fixed_point(docs)), ["doc_id", "entry_idx", "code"])
    return changed.groupBy("code", "change").agg(F.sum("n").alias("n"))


def fix06_hunk(spark, sf_dir):
    k_, a = k(), F.concat_ws("\n", F.lit("a"), k().cast("string"), F.lit("c"), F.lit("d"))
    b = F.when(k_ % 4 == 0, a).when(k_ % 4 == 1, F.concat_ws("\n", F.lit("a"), F.lit("x"), F.lit("y"), F.lit("c"), F.lit("d"))).when(k_ % 4 == 2, F.concat_ws("\n", F.lit("a"), F.lit("d"))).otherwise(F.concat(a, F.lit("\ne")))
    h = fixes.single_hunk(a, b)
    return _customers(spark, sf_dir).select("c_custkey", h["start"].alias("start"), F.size(h["removed"]).alias("removed"), F.size(h["added"]).alias("added"))


_C = "SELECT c_custkey"
_AUDIT = """a AS (SELECT user_id AS reference_id, event_id AS i, ts, CASE WHEN i5 = 0 THEN 'T' || event_id WHEN i5 = 1 THEN ' ' WHEN i5 = 2 THEN 'only' END AS a_t, CASE WHEN i5 < 2 THEN '@misc{e' || event_id || '}' END AS ab,
   CASE WHEN event_id % 2 = 0 THEN 'B' || event_id END AS bt, CASE WHEN event_id % 2 = 0 THEN '@misc{e' || event_id || '}' END AS bb, i5, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS revision FROM (SELECT *, event_id % 5 AS i5 FROM events))"""
_PROBLEM = """CASE WHEN et IS NULL THEN 'type' WHEN venue IS NOT NULL AND c_custkey % 8 = 0 THEN 'venue' WHEN lacks <> '' THEN 'incomplete:' || lacks END"""

QUERIES = {
    "lib12_revisions": lib12_revisions, "lib11_snapshots": lib11_snapshots, "lib10_baselines": lib10_baselines, "lib15b_actions": lib15b_actions, "lib03_get": lib03_get, "lib07_contexts": lib07_contexts, "lib15_sessions": lib15_sessions,
    "srt04_history": srt04_history, "lib14_registry": lib14_registry, "jon09_by_provider": jon09_by_provider, "er22_providers": er22_providers, "srt06_queries": srt06_queries, "srt07_details": srt07_details, "er12_evidence": er12_evidence,
    "er23_local": er23_local, "er16_final": er16_final, "er15_synthesis": er15_synthesis, "er18_clues": er18_clues, "er20_titles": er20_titles, "er24_pickers": er24_pickers, "src05_layout": src05_layout, "tx13_layout": tx13_layout,
    "src11_feed": src11_feed, "tx05_unnumbered": tx05_unnumbered, "tx15_repair": tx15_repair, "tx15_merged": tx15_merged, "snk04_summaries": snk04_summaries, "exp19_rendered": exp19_rendered, "par13_utf16": par13_utf16,
    "par14_inspect": par14_inspect, "fix11_new_keys": fix11_new_keys, "fix10_filled": fix10_filled, "fix08_canonical": fix08_canonical, "fix09_delta": fix09_delta, "fix06_hunk": fix06_hunk,
}
ORACLES = {
    "lib12_revisions": f"WITH {_AUDIT} SELECT reference_id, revision, coalesce(nullif(trim(a_t), ''), nullif(trim(bt), ''), reference_id::VARCHAR) AS title, coalesce(ab, bb) AS bibtex, i5 < 2 AS restorable FROM a",
    "lib11_snapshots": f"WITH {_AUDIT} SELECT i AS event_id, CASE WHEN i5 = 0 THEN 2 WHEN i5 < 3 THEN 1 END::INT AS version, ab AS bibtex, CASE WHEN i5 < 3 THEN ab IS NOT NULL END AS complete FROM a",
    "lib10_baselines": f"WITH {_AUDIT} SELECT reference_id, revision + 1 AS revision, 'baseline' AS action FROM a WHERE i5 IN (2, 4) AND revision = (SELECT max(revision) FROM a b WHERE b.reference_id = a.reference_id)",
    "lib15b_actions": f"WITH {_AUDIT} SELECT CASE WHEN i5 > 2 THEN 'delete' ELSE 'change' END AS action, i5 > 2 AND i % 2 = 1 AS lost, count(*) AS n FROM a GROUP BY 1, 2",
    "lib03_get": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'view')",
    "lib07_contexts": "WITH e AS (SELECT user_id, event_type, min((ts, event_id)) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL), g AS (SELECT user_id, count(*)::INT AS n, arg_min(event_type, m) AS f FROM e GROUP BY 1) SELECT c_custkey AS reference_id, coalesce(n, 0)::INT AS n_contexts, f AS first_context, CASE WHEN n IS NULL THEN 1 ELSE 2 END::INT AS revision FROM customer LEFT JOIN g ON user_id = c_custkey",
    "lib15_sessions": """WITH s AS (SELECT user_id, event_id, ts, ts + INTERVAL 7 DAY AS x, CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 1 DAY END AS r FROM events WHERE event_type = 'signup'), o AS (SELECT user_id, min(ts) AS d FROM events WHERE event_type = 'error' GROUP BY 1),
      j AS (SELECT *, coalesce(r, CASE WHEN d < x THEN greatest(d, ts) END) AS rv FROM s LEFT JOIN o USING (user_id)) SELECT event_id AS session_id, CASE WHEN rv <= TIMESTAMP '2024-01-25' THEN 'revoked' WHEN x <= TIMESTAMP '2024-01-25' THEN 'expired' ELSE 'open' END AS status, least(x, rv) + INTERVAL 10 DAY <= TIMESTAMP '2024-01-25' AS removed FROM j""",
    "srt04_history": "SELECT event_type AS kind, event_id AS revision, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) DESC, user_id, event_id DESC)::INT AS place FROM events",
    "lib14_registry": f"WITH {BASE}, v AS (SELECT doc_id, e, CASE WHEN k % 3 = 2 THEN NULL WHEN k % 10 = 3 THEN 'journal of parts' ELSE 'venue ' || (k % 5) END AS a FROM b) SELECT doc_id, e AS entry_idx, CASE a WHEN 'journal of parts' THEN 'jop' WHEN 'venue 1' THEN 'v1' ELSE 'own2' END AS venue_id, CASE a WHEN 'journal of parts' THEN 'journal' WHEN 'venue 1' THEN 'conference' ELSE 'workshop' END AS kind FROM v WHERE a IN ('journal of parts', 'venue 1', 'venue 2')",
    "jon09_by_provider": f"WITH {_SCORED} SELECT ref_id, source, record_id FROM s",
    "er22_providers": f"{_C} AS ref_id, unnest(CASE WHEN c_custkey % 4 < 2 THEN ['arxiv'] ELSE ['crossref', 'arxiv', 'local'] END) AS source FROM customer",
    "srt06_queries": "SELECT user_id AS ref_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view')::INT, event_id)::INT AS place FROM events",
    "srt07_details": "WITH s AS (SELECT user_id AS ref_id, event_id AS record_id, round(event_id % 101 / 100, 2) AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, record_id) AS place FROM s) SELECT ref_id, record_id, place FROM r WHERE place <= 3 AND NOT EXISTS (SELECT 1 FROM r q WHERE q.ref_id = r.ref_id AND q.place < r.place AND q.score >= 0.9)",
    "er12_evidence": f"WITH x AS ({_C}, CASE WHEN c_custkey % 5 = 0 THEN 'doi_missing' WHEN c_custkey % 3 = 0 THEN 'doi_mismatch' WHEN c_custkey % 4 = 0 THEN 'title_missing' WHEN c_custkey % 10 < 8 THEN 'title_mismatch' END AS reason FROM customer) SELECT c_custkey, reason IS NULL AS accepted, reason FROM x",
    "er23_local": f"{_C} FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 6 <> 0 ELSE c_custkey % 11 >= 8 AND c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 END",
    "er16_final": "WITH e AS (SELECT user_id AS ref_id, event_id AS i FROM events), s AS (SELECT ref_id, min(i) AS stop FROM e WHERE i % 17 = 0 GROUP BY 1) SELECT ref_id, min(i) AS ord FROM e LEFT JOIN s USING (ref_id) WHERE i % 4 = 0 AND i % 3 <> 0 AND i % 17 <> 0 AND i < coalesce(stop, i + 1) GROUP BY 1",
    "er15_synthesis": f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'article' WHEN 2 THEN 'inproceedings' END AS et, CASE WHEN c_custkey % 6 <> 0 THEN 'v' END AS venue,
      concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'author' END, CASE WHEN c_custkey % 14 = 0 THEN 'year' END, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 2 = 0 THEN 'venue' END) AS lacks FROM customer), p AS (SELECT *, {_PROBLEM} AS problem FROM x)
      SELECT c_custkey AS id, et AS entry_type, problem, CASE WHEN problem IS NULL THEN concat_ws(',', 'title@crossref', 'authors@crossref', 'year@crossref', 'venue@crossref') END AS provenance FROM p""",
    "er18_clues": f"{_C} AS ref_id, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'found' END AS title, CASE WHEN c_custkey % 3 = 0 THEN '2001' END AS year FROM customer",
    "er20_titles": "WITH s AS (SELECT c_custkey AS k, lower(c_mktsegment) AS m FROM customer) SELECT k AS c_custkey, CASE WHEN k % 2 = 0 THEN m || ',nlp,berts,study,tools' ELSE m || ',use,tools' END AS concepts, CASE WHEN k % 2 = 0 THEN 'nlp' ELSE 'use' END AS concept FROM s",
    "er24_pickers": """SELECT c_custkey, c_name AS first, 2000 + c_custkey % 9 AS year, 5 AS month, NULL::INT AS day, CASE WHEN c_custkey % 2 = 0 THEN 'y' ELSE 'x' END AS text, CASE WHEN c_custkey % 3 = 0 THEN 'ja' ELSE 'en' END AS language FROM customer""",
    "src05_layout": f"{_C} AS doc_id, 5::BIGINT AS n, 5::INT AS last FROM customer",
    "tx13_layout": f"{_C} AS doc_id, 'On Case ' || c_custkey AS title, 'Ann Lee' || (c_custkey % 7) || '; Bob Ray; Cy Day' AS authors, 'We study case ' || c_custkey AS abstract FROM customer",
    "src11_feed": f"{_C}, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, 'A <b> of ' || c_mktsegment AS title, 'Ann; B & C' AS authors FROM customer WHERE c_custkey % 5 <> 0",
    "tx05_unnumbered": f"{_C} FROM customer WHERE c_custkey % 3 < 2",
    "tx15_repair": f"{_C} AS ref_id, CASE WHEN c_custkey % 2 = 0 THEN 't' WHEN c_custkey % 5 <> 0 THEN 'new t' ELSE '' END AS title, CASE WHEN c_custkey % 3 <> 0 THEN 'J' WHEN c_custkey % 5 <> 0 THEN 'New J' ELSE 'J, 2001, pp. 3' END AS venue FROM customer",
    "tx15_merged": f"{_C}, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::INT AS n FROM customer",
    "snk04_summaries": """WITH x AS (SELECT c_custkey, 'On "' || c_custkey || '"' AS t, c_mktsegment AS a, c_custkey % 9 AS n FROM customer) SELECT c_custkey, 'json' AS form, '{"title":"' || replace(t, '"', '\\"') || '","authors":"' || a || '","references":' || n || '}' AS text FROM x
      UNION ALL SELECT c_custkey, 'csv', '"' || replace(t, '"', '""') || '","' || a || '",' || n FROM x UNION ALL SELECT c_custkey, 'markdown', '# ' || t || chr(10) || '- Authors: ' || a || chr(10) || '- References: ' || n FROM x UNION ALL SELECT c_custkey, 'text', 'Title: ' || t || chr(10) || 'Authors: ' || a || chr(10) || 'References: ' || n FROM x""",
    "exp19_rendered": f"{_C}, '@misc{{c' || c_custkey || ',' || chr(10) || '  title = {{T' || c_custkey || '}}' || CASE WHEN c_custkey % 2 = 0 THEN ',' || chr(10) || '  year = {{2000}}' ELSE '' END || chr(10) || '}}' AS bibtex FROM customer",
    "par13_utf16": f"{_C}, [0, 1, 2, 2, 3, 3, 3, 3, 5, 6, 6, 6][c_custkey % 12 + 1]::INT AS at FROM customer",
    "par14_inspect": f"WITH {K} SELECT doc_id, e AS entry_idx, 'c' || k AS key, 'title' AS name, (3 + (k % 13 = 0)::INT + (k % 10 = 1)::INT + (k % 5 < 2)::INT + (k % 4 = 0)::INT + (k % 12 = 0)::INT + (k % 6 < 3)::INT + 2 * (k % 10 IN (3, 8))::INT + (k % 9 < 4)::INT + (k % 18 = 0 OR k % 21 = 0)::INT)::INT AS n FROM k",
    "fix11_new_keys": f"WITH {K} SELECT doc_id, e AS entry_idx, 'new:C' || k AS citation_key, (3 + (k % 13 = 0)::INT + (k % 10 = 1)::INT + (k % 5 < 2)::INT + (k % 4 = 0)::INT + (k % 12 = 0)::INT + (k % 6 < 3)::INT + 2 * (k % 10 IN (3, 8))::INT + (k % 9 < 4)::INT + (k % 18 = 0 OR k % 21 = 0)::INT)::INT AS n FROM k",
    "fix10_filled": f"WITH {K} SELECT doc_id, e AS entry_idx, CASE WHEN e % 4 <> 3 THEN 'Press' END AS publisher, e % 4 <> 3 AND k % 17 = 0 AS filled, true AS portable FROM k",
    "fix08_canonical": f"WITH {K} SELECT DISTINCT doc_id, true AS fixed_kept, doc_id % 2 <> 0 AS other_kept FROM k",
    "fix09_delta": f"WITH {K}, d AS (SELECT 'BIB-SYNTAX-002' AS code, count(*) AS n FROM k WHERE k % 10 IN (3, 8) UNION ALL SELECT 'BIB-SYNTAX-005', 2 * count(*) FROM k WHERE k % 18 = 0 UNION ALL SELECT 'BIB-SYNTAX-006', count(*) FROM k WHERE k % 16 = 0 UNION ALL SELECT 'BIB-SYNTAX-009', count(*) FROM k WHERE k % 18 = 0) SELECT code, 'removed' AS change, n::BIGINT AS n FROM d WHERE n > 0",
    "fix06_hunk": f"{_C}, CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 3 THEN 5 ELSE 2 END::INT AS start, CASE c_custkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INT AS removed, CASE c_custkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END::INT AS added FROM customer",
}
