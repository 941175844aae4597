"""Profile rules, reconstruction, citation strings, configuration and sessions over derived rows; the SQL tells them from the tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import citations, extract, library, policy, reconstruct, resolve, semantic
from ..sources import corpus, table
from ..streaming import states
from .bibtex import _VENUE, _YEAR, BASE, _diagnostics, _entries

ORDER = ("title", "author", "journal", "booktitle", "year", "doi")


def val03_field_order(spark, sf_dir):
    return policy.out_of_order(_entries(spark, sf_dir), ORDER).select("doc_id", "entry_idx")


def val23_key_pattern(spark, sf_dir):
    return policy.bad_keys(_entries(spark, sf_dir), "^[a-z]+[0-9]+$")


def _venues(spark):
    rows = [("journal of parts", "jop", "journal", 0), ("journal of parts", "other", "conference", 1), *[(f"venue {i}", f"v{i}", "conference" if i % 2 else "journal", 2 + i) for i in range(4)]]
    return spark.createDataFrame(rows, "alias string, venue_id string, kind string, ord int")


def sem27_venue_join(spark, sf_dir):
    return policy.with_venue_kind(semantic.records(_entries(spark, sf_dir)), _venues(spark)).select("doc_id", "entry_idx", "venue_id", "kind")


def val15_venue_kind(spark, sf_dir):
    return policy.kind_mismatch(policy.with_venue_kind(semantic.records(_entries(spark, sf_dir)), _venues(spark))).select("doc_id", "entry_idx", "entry_type", "kind")


def val27_arxiv(spark, sf_dir):
    return policy.arxiv_representation(_entries(spark, sf_dir))


def val34_completeness(spark, sf_dir):
    return policy.completeness(_entries(spark, sf_dir)).where("missing <> ''")


def val30_selector(spark, sf_dir):
    d = _diagnostics(spark, sf_dir).where(policy.selected(F.col("code"), exclude=["BIB-SYNTAX-004"]) & policy.at_least(F.col("severity"), "warning"))
    return d.groupBy("severity").agg(F.count("*").alias("n"))


def ref_rows(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), F.md5(k.cast("string")))
    return table(spark, sf_dir, "part").select(k.alias("ref_id"), title.alias("title"), F.concat(F.lit("Smith"), k % 10).alias("authors"), (1990 + k % 30).cast("int").alias("year"), F.when(k % 3 == 0, F.concat(F.lit("10.1000/part."), k)).alias("doi"))


def provider_rows(spark, sf_dir):
    """Records of two providers: equal titles, titles with a word more, equal identifiers, and years that differ."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" "), F.md5(k.cast("string")))
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1000/part."), k))

    def row(off, source, where, named, year):
        return part.where(where).select((k * 10 + off).alias("record_id"), F.lit(source).alias("source"), named.alias("title"), F.concat(F.lit("Smith"), k % 10).alias("authors"), year.cast("int").alias("year"), doi.alias("doi"))

    a = row(1, "crossref", k % 2 == 0, F.concat(title, F.when(k % 4 == 2, " revisited").otherwise("")), 1990 + k % 30)
    b = row(2, "arxiv", k % 5 == 0, F.concat(F.lit("{"), F.upper(title), F.lit("}")), 1990 + k % 30 + F.when(k % 15 == 0, 1).otherwise(0))
    return a.unionByName(b)


def jon12_scored(spark, sf_dir):
    """Candidates of the trusted score or more."""
    return reconstruct.scored(ref_rows(spark, sf_dir), provider_rows(spark, sf_dir), least=reconstruct.TRUSTED)


def title_rows(spark, sf_dir):
    """(ref_id, title, authors, year, doi): the first eight words of every document, as they stand; copies share titles and other works have near ones."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(k.alias("ref_id"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 8), " ").alias("title"), F.concat("lang", F.lit(" "), "source").alias("authors"), (2000 + k % 20).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"))


def found_title_rows(spark, sf_dir):
    """Records of the same works under other titles: a word left out, two letters exchanged, in capitals and braces, or two words more."""
    r = title_rows(spark, sf_dir)
    k, t = F.col("ref_id"), F.col("title")
    words = F.split(t, " ")
    other = F.when(k % 4 == 0, F.array_join(F.concat(F.slice(words, 1, 2), F.slice(words, 4, 9)), " ")).when(k % 4 == 1, F.concat(F.substring(t, 1, 5), F.substring(t, 7, 1), F.substring(t, 6, 1), F.substring(t, F.lit(8), F.char_length(t)))).when(k % 4 == 2, F.concat(F.lit("{"), F.upper(t), F.lit("}"))).otherwise(F.concat(t, F.lit(" revisited twice")))
    authors = F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit("someone else")).otherwise(F.col("authors"))
    return r.select((k * 10 + 1).alias("record_id"), F.lit("crossref").alias("source"), other.alias("title"), authors.alias("authors"), (F.col("year") + F.when(k % 9 == 0, 1).otherwise(0)).cast("int").alias("year"), "doi")


def jon11_near_titles(spark, sf_dir):
    """Candidates of a score of 0.6 or more, matches and weak ones: near titles of other works take part."""
    found = reconstruct.scored(title_rows(spark, sf_dir), found_title_rows(spark, sf_dir), least=0.6)
    return found.withColumn("status", resolve.status(F.col("score"))).drop("found_doi")


def er13_selected(spark, sf_dir):
    return reconstruct.selected(ref_rows(spark, sf_dir), jon12_scored(spark, sf_dir))


def er11_trusted_doi(spark, sf_dir):
    return reconstruct.trusted_doi(jon12_scored(spark, sf_dir))


def agg14_outcomes(spark, sf_dir):
    return er13_selected(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def jon15_conflicts(spark, sf_dir):
    return reconstruct.conflicts(provider_rows(spark, sf_dir))


def er19_citation_key(spark, sf_dir):
    k = F.col("p_partkey")
    key = reconstruct.citation_key(F.concat(F.lit("Smith"), k % 10, F.lit(", Ann and Bob Jones")), 1990 + k % 30, F.col("p_brand"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(k, key.alias("citation_key"))


def er09_candidate_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", reconstruct.candidate_id(F.col("p_brand"), F.col("p_partkey")).alias("candidate_id"))


def _citation_docs(spark, sf_dir):
    """Ten citations of parts for each document, after a reference header."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("["), k % 10 + 1, F.lit("] Smith"), k % 10, F.lit(", Ann and Jones"), k % 7, F.lit(", Bob ("), 1990 + k % 30, F.lit("). "), F.initcap("p_name"), F.lit(" study. In Journal of Parts,\n  "), k % 90 + 1, F.lit("("), k % 4 + 1, F.lit("), pp. "), k % 300, F.lit("-"), k % 300 + 9, F.lit(". doi:10.1000/part."), k, F.lit("."))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n")
    return table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("doc_id")).agg(F.concat(F.lit("Title of a paper\nReferences are cited\nReferences\n[1] decoy\nbody\n REFERENCES \nReferences\n"), lines).alias("text"))


def _reference_lists(spark, sf_dir):
    """Papers of ten parts' references: numbered over two lines, parted by blank lines, or run together; a section follows."""
    k = F.col("p_partkey")
    lead, rest = F.lit("Smith, A. and Bob van der Jones. "), F.concat(1990 + k % 30, F.lit(". Study of "), "p_name", F.lit(" case "), k, F.lit(". In Journal of Parts."))
    kind = F.floor(k / 10) % 3
    one = F.when(kind == 0, F.concat(F.lit("["), k % 10 + 1, F.lit("] "), F.substring_index(lead, " ", 3), F.lit("\n   "), F.substring_index(lead, " ", -5), rest)).otherwise(F.concat(lead, rest))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), one.alias("t")))), lambda x: x["t"])
    by = table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("doc_id")).agg(rows.alias("rows"), F.first(kind).alias("kind"))
    body = F.when(F.col("kind") == 0, F.array_join("rows", "\n")).when(F.col("kind") == 1, F.array_join("rows", "\n\n")).otherwise(F.array_join("rows", " "))
    return by.select("doc_id", F.concat(F.lit("A paper\nReferences\nold list\nBody text.\nReferences\n"), body, F.lit("\nAppendix A\n[1] Not a reference any more.\n")).alias("text"))


def tx05_references(spark, sf_dir):
    """References of papers in all three forms, up to the section that follows."""
    lines = extract.lines(_reference_lists(spark, sf_dir))
    return extract.references(extract.reference_block(lines, citations.HEADER))


def er08_statuses(spark, sf_dir):
    """How many parts have which status at which provider: scores and failures by key."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "crossref").otherwise("arxiv").alias("source"), (k % 11 / 10).alias("score"), (k % 13 == 0).alias("failed"))
    return rows.groupBy("source", resolve.status(F.col("score"), F.col("failed")).alias("status")).agg(F.count("*").alias("n"))


def srt09_users(spark, sf_dir):
    """The second page of users in order of their mail address."""
    c = table(spark, sf_dir, "customer")
    mail = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), F.lit("."), F.reverse(F.col("c_custkey").cast("string")), F.lit("@example.org"))
    return library.users_by_mail(c.select(F.col("c_custkey").alias("id"), mail.alias("mail"), F.lit("active").alias("status")), 50, 50)


def src10_embedded(spark, sf_dir):
    """BibTeX that pages of documents hold, in one of three elements, escaped, after another block; every fifth page has none."""
    d = F.col("doc_id")
    escaped = F.replace(F.replace(F.replace(F.col("source"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    kind = F.get(F.array(*[F.lit(x) for x in ("pre", "textarea", "code")]), (d % 3).cast("int"))
    block = F.when(d % 5 == 0, F.lit("<pre>no entry</pre>")).otherwise(F.concat(F.lit("<"), kind, F.lit(" class='x'>"), escaped, F.lit("</"), kind, F.lit(">")))
    html = F.concat(F.lit("<html><body><code>x = 1</code>"), block, F.lit("<pre>@misc{later, }</pre></body></html>"))
    return corpus.documents(spark, sf_dir).select("doc_id", F.sha2(extract.embedded_bibtex(html), 256).alias("sha256"))


def tx10_citations(spark, sf_dir):
    return citations.parsed(citations.section(_citation_docs(spark, sf_dir))).select("doc_id", F.col("entry").cast("long").alias("entry"), "authors", "title", "venue", "year", "pages", "doi")


def tx14_alias_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("payload", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"key": "'), F.col("event_id"), F.lit('"}'))))
    return e.select("event_id", citations.alias_value(F.col("payload"), ("k", "key")).alias("value"))


def str06_challenges(spark, sf_dir):
    """Login requests: rejected within the cooldown or past the hourly limit, the latest accepted one of each user live."""
    from ..operators import events

    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    judged = events.cooldown(events.trailing_count(e, "user_id", "ts", 86400), "user_id", "ts", "event_id", 3600)
    status = F.when(F.col("rejected"), "cooldown").when(F.col("recent") > 3, "limited").otherwise("accepted")
    out = judged.withColumn("status", status)
    newest = F.max(F.when(F.col("status") == "accepted", F.struct("ts", "event_id"))).over(Window.partitionBy("user_id"))
    return out.select("event_id", "status", F.coalesce(newest["event_id"] == F.col("event_id"), F.lit(False)).alias("live"))


def _keyed(spark, sf_dir, first, then):
    """Events of users as events of keyed state, six hundred times as dense; signups and purchases open, others check."""
    e = table(spark, sf_dir, "events")
    opens = F.col("event_type").isin("signup", "purchase")
    rows = e.select("user_id", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600)).alias("at"), "event_id", F.when(opens, first).otherwise(then).alias("kind"), (F.col("event_id") % 2).alias("who"), F.when(opens, F.col("user_id") % 3).otherwise(F.col("event_id") % 3).alias("code"))
    return states.events(rows, "user_id", "at", "event_id", "kind", "who", "code")


def str06_codes(spark, sf_dir):
    """Login codes: cooldown, superseding, five attempts, ten minutes."""
    return states.fold(_keyed(spark, sf_dir, "request", "verify"), "challenge").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "status")


def str03_requests(spark, sf_dir):
    """Pending requests: consumed once, by their owner, in time."""
    return states.fold(_keyed(spark, sf_dir, "create", "consume"), "pending").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "status")


def str07_sessions(spark, sf_dir):
    """Sessions of seven days, ended by a later purchase of the user: open, expired or revoked at a moment."""
    at = F.lit(datetime.datetime(2024, 1, 20))
    e = table(spark, sf_dir, "events").where(F.col("ts") <= at)
    ended = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ended"))
    s = e.where("event_type = 'signup'").join(ended, "user_id", "left")
    status = F.when(F.col("ended") > F.col("ts"), "revoked").when(F.col("ts") + F.expr("interval 7 days") <= at, "expired").otherwise("open")
    return s.select("event_id", status.alias("status"))


def lib13_config_save(spark, sf_dir):
    """What saving a setting does: create, override, update or nothing, from what is built in and stored."""
    n = table(spark, sf_dir, "customer")
    base = n.where("c_custkey % 7 <> 0").select("c_custkey", F.col("c_name").alias("base"))
    stored = n.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("stored"))
    asked = n.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("asked"))
    joined = asked.join(base, "c_custkey", "left").join(stored, "c_custkey", "left")
    now = F.coalesce("stored", "base")
    action = F.when(now == F.col("asked"), "none").when(F.col("stored").isNotNull(), "update").when(F.col("base").isNotNull(), "override").otherwise("create")
    return joined.select("c_custkey", action.alias("action"))


def lib05_update(spark, sf_dir):
    """Optimistic updates: stale unless the expected revision is the stored source's."""
    from ..functions.normalize import revision

    p = table(spark, sf_dir, "part").select("p_partkey", revision(F.col("p_name")).alias("stored"), revision(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("expected"))
    return p.select("p_partkey", F.when(F.col("stored") == F.col("expected"), "updated").otherwise("stale").alias("status"), "stored")


def set07_options(spark, sf_dir):
    """Selection options with equal text kept once, by strategy."""
    p = table(spark, sf_dir, "part")
    options = p.select(F.col("p_name").alias("text"), (F.col("p_partkey") % 3).cast("int").alias("strategy"), F.col("p_partkey").alias("id"))
    return options.groupBy("text").agg(F.min(F.struct("strategy", "id")).alias("m")).select("text", "m.strategy", "m.id")


def ext_cube(spark, sf_dir):
    """Extension: diagnostics by code and severity in all groupings."""
    return _diagnostics(spark, sf_dir).rollup("severity", "code").agg(F.count("*").alias("n")).where("code is null").select(F.coalesce("severity", F.lit("all")).alias("severity"), "n")


_CODES = "('BIB-SYNTAX-001','error',(k % 13 = 0 AND k % 41 <> 0)::INT),('BIB-SYNTAX-002','warning',(k % 29 = 0)::INT),('BIB-SYNTAX-005','warning',2 * (k % 11 = 0)::INT),('BIB-SEMANTIC-001','warning',(k % 17 = 0)::INT),('BIB-SEMANTIC-003','error',(k % 3 < 2 AND k % 41 = 0 AND k % 13 <> 0)::INT)"
_DUPS = " UNION ALL ".join(f"SELECT '{s}', count(*) FROM (SELECT 1 FROM b GROUP BY doc_id, {v} HAVING count(*) > 1)" for s, v in (("error", "lower(ck)"), ("warning", "lower(doi)")))
_SEV = f"s AS (SELECT severity, sum(n) AS n FROM (SELECT t.severity, sum(t.n) AS n FROM b, LATERAL (VALUES {_CODES}) AS t(code, severity, n) GROUP BY 1 UNION ALL {_DUPS}) GROUP BY 1)"
_KIND = "CASE WHEN k % 3 = 2 THEN NULL WHEN k % 10 = 3 THEN 'journal' WHEN k % 5 = 4 THEN NULL WHEN k % 5 % 2 = 1 THEN 'conference' ELSE 'journal' END"
_VID = "CASE WHEN k % 3 = 2 THEN NULL WHEN k % 10 = 3 THEN 'jop' WHEN k % 5 = 4 THEN NULL ELSE 'v' || (k % 5) END"
_PART = "p AS (SELECT p_partkey AS k, p_name, p_brand FROM part)"
#: A title of n characters and its copy with ten more have the ratio 2n / (2n + 10); equal authors add 0.3 to 0.7 of it.
_SCORED = f"""{_PART}, n AS (SELECT *, length(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) + 33 AS n FROM p), s AS (
  SELECT k AS ref_id, k * 10 + 1 AS record_id, 'crossref' AS source, CASE WHEN k % 3 = 0 THEN '10.1000/part.' || k END AS found_doi,
         CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN 1.0 ELSE round(0.7 * (2 * n / (2 * n + 10)) + 0.3, 6) END::DOUBLE AS score, true AS consistent FROM n WHERE k % 2 = 0 AND (k % 4 = 0 OR k % 3 = 0 OR k % 5 <> 0)
  UNION ALL SELECT k, k * 10 + 2, 'arxiv', CASE WHEN k % 3 = 0 THEN '10.1000/part.' || k END, 1.0, k % 15 <> 0 FROM n WHERE k % 5 = 0)"""

#: A key's events folded one by one: columns la, ends, wrong and held are the state.
_KEYED = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 600 AS t, event_type IN ('signup', 'purchase') AS opens, (event_id % 2)::VARCHAR AS who, (CASE WHEN event_type IN ('signup', 'purchase') THEN user_id % 3 ELSE event_id % 3 END)::VARCHAR AS code,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 600, event_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, NULL::BIGINT AS la, 0::BIGINT AS ends, 0 AS wrong, NULL::VARCHAR AS held, NULL::VARCHAR AS status FROM events
      UNION ALL SELECT user_id, event_id, n, {la}, {ends}, {wrong}, {held}, status FROM
        (SELECT o.user_id, o.event_id, o.n, o.t, o.who, o.code, la, ends, wrong, held, {status} AS status FROM s JOIN o ON s.user_id = o.user_id AND o.n = s.n + 1))
    SELECT user_id, event_id, status FROM s WHERE n > 0"""

QUERIES = {
    "val03_field_order": val03_field_order, "val23_key_pattern": val23_key_pattern, "sem27_venue_join": sem27_venue_join, "val15_venue_kind": val15_venue_kind, "val27_arxiv": val27_arxiv,
    "val34_completeness": val34_completeness, "val30_selector": val30_selector, "jon12_scored": jon12_scored, "jon11_near_titles": jon11_near_titles, "er13_selected": er13_selected, "er11_trusted_doi": er11_trusted_doi, "agg14_outcomes": agg14_outcomes,
    "jon15_conflicts": jon15_conflicts, "er19_citation_key": er19_citation_key, "er09_candidate_id": er09_candidate_id, "tx10_citations": tx10_citations, "tx14_alias_keys": tx14_alias_keys,
    "str06_challenges": str06_challenges, "str06_codes": str06_codes, "str03_requests": str03_requests, "tx05_references": tx05_references, "er08_statuses": er08_statuses, "srt09_users": srt09_users, "src10_embedded": src10_embedded, "str07_sessions": str07_sessions, "lib13_config_save": lib13_config_save, "lib05_update": lib05_update, "set07_options": set07_options, "ext_rollup": ext_cube,
}
ORACLES = {
    "val03_field_order": f"WITH {BASE} SELECT doc_id, e AS entry_idx FROM b WHERE k % 3 < 2 AND (k % 41 <> 0 OR k % 13 = 0)",
    "val23_key_pattern": f"WITH {BASE} SELECT doc_id, e AS entry_idx, ck AS citation_key, lower(ck) AS proposal FROM b WHERE ck <> lower(ck)",
    "sem27_venue_join": f"WITH {BASE} SELECT doc_id, e AS entry_idx, {_VID} AS venue_id, {_KIND} AS kind FROM b",
    "val15_venue_kind": f"WITH {BASE}, x AS (SELECT doc_id, e AS entry_idx, et AS entry_type, {_KIND} AS kind FROM b) SELECT * FROM x WHERE kind IS NOT NULL AND ((entry_type = 'article' AND kind <> 'journal') OR (entry_type = 'inproceedings' AND kind NOT IN ('conference', 'workshop')))",
    "val27_arxiv": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'primaryclass' AS lacking FROM b WHERE k % 3 = 2",
    "val34_completeness": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'year' AS missing FROM b WHERE {_YEAR} IS NULL",
    "val30_selector": f"WITH {BASE}, {_SEV} SELECT severity, n::BIGINT AS n FROM s WHERE n > 0",
    "jon12_scored": f"WITH {_SCORED} SELECT * FROM s",
    "er13_selected": f"WITH {_SCORED}, t AS (SELECT ref_id, arg_min(record_id, CASE source WHEN 'crossref' THEN 10 ELSE 40 END) AS record_id FROM s WHERE consistent GROUP BY 1) SELECT k AS ref_id, CASE WHEN record_id IS NULL THEN 'manual_review' ELSE 'ready' END AS outcome, record_id FROM p LEFT JOIN t ON ref_id = k",
    "er11_trusted_doi": f"WITH {_SCORED} SELECT DISTINCT ref_id, found_doi AS doi FROM s WHERE consistent AND found_doi IS NOT NULL",
    "agg14_outcomes": f"WITH {_SCORED}, t AS (SELECT DISTINCT ref_id FROM s WHERE consistent) SELECT CASE WHEN ref_id IS NULL THEN 'manual_review' ELSE 'ready' END AS outcome, count(*) AS n FROM p LEFT JOIN t ON ref_id = k GROUP BY 1",
    "jon15_conflicts": f"WITH {_PART} SELECT '10.1000/part.' || k AS doi, unnest(['title', 'year']) AS field FROM p WHERE k % 30 = 0",
    "er19_citation_key": "WITH w AS (SELECT p_partkey, p_brand, list_filter(string_split(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '-'), lambda x: length(x) > 3 AND x NOT IN ('with', 'from', 'that', 'using'))[1] AS c FROM part) SELECT p_partkey, 'smith' || (p_partkey % 10) || '-' || (1990 + p_partkey % 30) || '-' || regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || CASE WHEN c IS NULL THEN '' ELSE '-' || c END AS citation_key FROM w",
    "er09_candidate_id": """SELECT p_partkey, substring(sha256('{"record_id": "' || p_partkey || '", "source": "' || p_brand || '"}'), 1, 16) AS candidate_id FROM part""",
    "tx10_citations": "SELECT p_partkey // 10 AS doc_id, p_partkey % 10 + 1 AS entry, 'Smith' || (p_partkey % 10) || ', Ann; Jones' || (p_partkey % 7) || ', Bob' AS authors, array_to_string(list_transform(string_split(regexp_replace(trim(p_name), '\\s+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' study' AS title, 'Journal of Parts' AS venue, (1990 + p_partkey % 30)::INT AS year, (p_partkey % 300) || '-' || (p_partkey % 300 + 9) AS pages, '10.1000/part.' || p_partkey AS doi FROM part",
    "tx14_alias_keys": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_id::VARCHAR END AS value FROM events",
    "str06_challenges": """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
      j AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000, false) AS rejected FROM e),
      s AS (SELECT *, CASE WHEN rejected THEN 'cooldown' WHEN recent > 3 THEN 'limited' ELSE 'accepted' END AS status FROM j)
      SELECT event_id, status, status = 'accepted' AND row_number() OVER (PARTITION BY user_id, status ORDER BY ts DESC, event_id DESC) = 1 AS live FROM s""",
    "str06_codes": _KEYED.format(
        status="CASE WHEN opens THEN CASE WHEN la >= t - 60000000 THEN 'cooldown' ELSE 'accepted' END WHEN ends <= t THEN 'none' WHEN code = held THEN 'ok' WHEN wrong + 1 >= 5 THEN 'ended' ELSE 'wrong' END",
        la="CASE WHEN status = 'accepted' THEN t ELSE la END", ends="CASE WHEN status = 'accepted' THEN t + 600000000 WHEN status IN ('none', 'ok', 'ended') THEN 0 ELSE ends END",
        wrong="CASE WHEN status = 'wrong' THEN wrong + 1 WHEN status = 'cooldown' THEN wrong ELSE 0 END", held="CASE WHEN status = 'accepted' THEN code WHEN status IN ('none', 'ok', 'ended') THEN NULL ELSE held END"),
    "str03_requests": _KEYED.format(
        status="CASE WHEN opens THEN 'created' WHEN ends <= t THEN 'expired' WHEN held <> who THEN 'wrong_user' ELSE 'ok' END",
        la="la", ends="CASE WHEN status = 'created' THEN t + 900000000 WHEN status IN ('expired', 'ok') THEN 0 ELSE ends END", wrong="wrong", held="CASE WHEN status = 'created' THEN who WHEN status IN ('expired', 'ok') THEN NULL ELSE held END"),
    "tx05_references": "SELECT p_partkey // 10 AS doc_id, (row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey))::INT AS entry, 'Smith, A. and Bob van der Jones. ' || (1990 + p_partkey % 30) || '. Study of ' || p_name || ' case ' || p_partkey || '. In Journal of Parts.' AS text FROM part",
    "er08_statuses": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'crossref' ELSE 'arxiv' END AS source, CASE WHEN p_partkey % 13 = 0 THEN 'api_error' WHEN p_partkey % 11 >= 8 THEN 'match' WHEN p_partkey % 11 > 0 THEN 'weak' ELSE 'not_found' END AS status, count(*) AS n FROM part GROUP BY ALL",
    "srt09_users": "WITH u AS (SELECT c_custkey AS id, lower(c_mktsegment) || '.' || reverse(c_custkey::VARCHAR) || '@example.org' AS mail FROM customer) SELECT id, mail, 'active' AS status, (row_number() OVER (ORDER BY mail, id))::INT AS place FROM u ORDER BY mail, id LIMIT 50 OFFSET 50",
    "src10_embedded": f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('@misc{{later, }}') ELSE sha256(source) END AS sha256 FROM {corpus.sql()}",
    "str07_sessions": "WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20'), x AS (SELECT user_id, max(ts) AS ended FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, CASE WHEN ended > ts THEN 'revoked' WHEN ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'open' END AS status FROM e LEFT JOIN x USING (user_id) WHERE event_type = 'signup'",
    "lib13_config_save": "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' ELSE c_name END AS asked, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS base, CASE WHEN c_custkey % 3 = 0 THEN c_name || '*' END AS stored FROM customer) SELECT c_custkey, CASE WHEN coalesce(stored, base) = asked THEN 'none' WHEN stored IS NOT NULL THEN 'update' WHEN base IS NOT NULL THEN 'override' ELSE 'create' END AS action FROM x",
    "lib05_update": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND upper(p_name) <> p_name THEN 'stale' ELSE 'updated' END AS status, 'sha256:' || sha256(p_name) AS stored FROM part",
    "set07_options": "SELECT p_name AS text, (p_partkey % 3)::INT AS strategy, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey % 3, p_partkey) = 1",
    "ext_rollup": f"WITH {BASE}, {_SEV}, a AS (SELECT severity, n + CASE WHEN severity = 'warning' THEN (SELECT sum((k % 7 = 0)::INT) FROM b) ELSE 0 END AS n FROM s) SELECT severity, n::BIGINT AS n FROM a UNION ALL SELECT 'all', sum(n)::BIGINT FROM a",
}
