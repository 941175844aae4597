"""Entity resolution and extraction queries on `documents`, `benchmark`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, resolve
from ..sources import table

_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= {n}))"


def _token_rows(df, ident, least):
    return df.select(F.col(ident).alias("id"), resolve.tokens(F.col("text"), least).alias("tokens"))


def _sides(spark, sf_dir):
    return _token_rows(table(spark, sf_dir, "benchmark"), "item_id", 3), _token_rows(table(spark, sf_dir, "documents"), "doc_id", 3)


def agg13_overlap(spark, sf_dir):
    return resolve.overlaps(*_sides(spark, sf_dir))


def jon10_shortlist(spark, sf_dir):
    return resolve.shortlist(*_sides(spark, sf_dir)).select("l", "r", "shared", "rank")


def er08_best(spark, sf_dir):
    items, docs = _sides(spark, sf_dir)
    found = resolve.best(resolve.shortlist(items, docs, 1).join(items.select(F.col("id").alias("l"), F.size("tokens").alias("n")), "l").withColumn("score", F.round(F.col("shared") / F.col("n"), 6)))
    return found.withColumn("status", resolve.status(F.col("score")))


def agg18_most_common(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.explode(resolve.tokens(F.col("p_name"))).alias("item"))
    return resolve.most_common(words, 5)


def er03_author_jaccard(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", resolve.tokens(F.concat_ws(" ", "s_name", F.lit("ann lee"))).alias("a"), resolve.tokens(F.concat(F.lit("Lee, Supplier 0000"), F.col("s_suppkey") % 7)).alias("b"))
    return s.select("s_suppkey", F.round(resolve.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def er21_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc_id"), F.col("p_partkey").alias("rec"), resolve.slug(F.substring_index("p_name", " ", 1)).alias("base"))
    return resolve.assign_keys(p)


def er02_title_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(resolve.title_similarity("p_name", "other"), 6).alias("similarity"))


def src12_code_block(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("see\n```bibtex\n"), "text", F.lit("\n```\nthanks"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```"), "text", F.lit("``` and ```x```"))).otherwise(F.col("text"))
    body = extract.code_block(fenced)
    return c.select("conv_id", "turn", F.char_length(body).cast("long").alias("n")).where("n is not null")


def src10_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(extract.links(F.col("html"))).cast("long").alias("n_links"), extract.title(F.col("html")).alias("title"))


def snk03_artifacts(spark, sf_dir):
    return extract.artifacts(table(spark, sf_dir, "pages"), "html")


def tx04_entries(spark, sf_dir):
    rows = extract.grouped_entries(extract.lines(table(spark, sf_dir, "documents")), "^[A-M]")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


def tx11_title(spark, sf_dir):
    return extract.longest_line(extract.lines(table(spark, sf_dir, "documents"))).select("doc_id", F.sha2("title", 256).alias("title_sha256"))


_PAIRS = f"""i AS (SELECT item_id AS l, {_TOKENS.format(c='text', n=3)} AS ts FROM benchmark), d AS (SELECT doc_id AS r, {_TOKENS.format(c='text', n=3)} AS ts FROM documents),
  dt AS (SELECT r, unnest(ts) AS t FROM d), it AS (SELECT l, len(ts) AS ln, unnest(ts) AS t FROM i), p AS (SELECT l, r, count(*) AS shared, any_value(ln) AS ln FROM it JOIN dt USING (t) GROUP BY l, r)"""
_LINES = "x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
_FENCED = "CASE turn % 3 WHEN 0 THEN 'see' || chr(10) || '```bibtex' || chr(10) || text || chr(10) || '```' || chr(10) || 'thanks' WHEN 1 THEN '```' || text || '``` and ```x```' ELSE text END"

QUERIES = {
    "agg13_overlap": agg13_overlap, "agg18_most_common": agg18_most_common, "jon10_shortlist": jon10_shortlist, "er08_best": er08_best, "er03_author_jaccard": er03_author_jaccard, "er21_keys": er21_keys, "er02_title_similarity": er02_title_similarity,
    "src12_code_block": src12_code_block, "src10_links": src10_links, "snk03_artifacts": snk03_artifacts, "tx04_entries": tx04_entries, "tx11_title": tx11_title,
}
ORACLES = {
    "agg13_overlap": f"WITH {_PAIRS} SELECT l, shared::INT AS shared, count(*) AS n FROM p GROUP BY ALL",
    "jon10_shortlist": f"WITH {_PAIRS}, k AS (SELECT l, r, shared, row_number() OVER (PARTITION BY l ORDER BY shared DESC, r)::INT AS rank FROM p) SELECT * FROM k WHERE rank <= 200",
    "er08_best": f"WITH {_PAIRS}, s AS (SELECT l, r, round(shared / ln, 6) AS score FROM p) SELECT l, r, score, CASE WHEN score >= 0.8 THEN 'match' WHEN score > 0 THEN 'weak' ELSE 'not_found' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, r) = 1",
    "er21_keys": """WITH b AS (SELECT p_partkey // 20 AS doc_id, p_partkey AS rec, regexp_replace(regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base FROM part)
      SELECT doc_id, rec, CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY rec) = 1 THEN base ELSE base || '-' || substring(sha256(rec || ':0'), 1, 8) END AS key FROM b""",
    "agg18_most_common": f"WITH w AS (SELECT p_partkey AS ord, unnest({_TOKENS.format(c='p_name', n=2)}) AS item FROM part) SELECT item, count(*) AS n FROM w GROUP BY item ORDER BY n DESC, min(ord) LIMIT 5",
    "er03_author_jaccard": f"WITH t AS (SELECT s_suppkey, {_TOKENS.format(c=chr(39).join(['s_name || ', ' ann lee', '']), n=2)} AS a, {_TOKENS.format(c=chr(39).join(['', 'Lee, Supplier 0000', ' || (s_suppkey % 7)']), n=2)} AS b FROM supplier) SELECT s_suppkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t",
    "src12_code_block": f"SELECT conv_id, turn, length(replace(replace(replace(text || chr(10), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))::BIGINT AS n FROM conversations WHERE turn % 3 = 0 AND text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '<http')",
    "src10_links": r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)))::BIGINT AS n_links, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages""",
    "snk03_artifacts": "SELECT 'sha256:' || sha256(html) AS artifact_id, count(*) AS n, max(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1",
    "tx04_entries": rf"WITH {_LINES}, o AS (SELECT *, sum(regexp_matches(line, '^[A-M]')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS entry FROM x), g AS (SELECT doc_id, entry, trim(regexp_replace(string_agg(trim(line), ' ' ORDER BY n), '\s+', ' ', 'g')) AS t FROM o WHERE entry > 0 GROUP BY 1, 2) SELECT doc_id, count(*) AS n_entries, sum(length(t))::BIGINT AS n_chars FROM g GROUP BY 1",
    "tx11_title": f"WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS q FROM x WHERE trim(line) <> '') SELECT doc_id, sha256(line) AS title_sha256 FROM f WHERE q <= 8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, n) = 1",
}
