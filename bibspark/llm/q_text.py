"""Queries over `documents` that need one text at a time, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, infill, licenses, pii, quality, secrets
from .common import UPPER, table

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op5_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def quality_sql(documents: str = "documents") -> str:
    """Statistics and verdict of every row of `documents`."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    metric = {
        "n_words": "n_words",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0.0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(word_chars, 0), 0.0)",
        "stop_words": "n_stop_words",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)",
        "repeat_word_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0.0)",
    }
    rules = " AND ".join(f"{metric[m]} {test} {bound}" for m, test, bound in quality.THRESHOLDS)
    return rf"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
                        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {documents}),
      win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d)),
      dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
      hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
      st AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
                    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
                    len(list_intersect(ws, [{stops}]))::BIGINT AS n_stop_words FROM d LEFT JOIN hit USING (doc_id)),
      v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM st)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
             NOT base_failed AND ({rules}) AS kept, n_lines, n_stop_words FROM v"""


def op1_secret_scan(spark, sf_dir):
    xs = F.col("spans")
    of = lambda k: F.size(F.filter(xs, lambda x: x["k"] == k)).cast("long")
    base = F.filter(xs, lambda x: x["k"] < 3)
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(xs).alias("spans"),
        F.size(F.filter(xs, lambda x: x["copied"])).cast("long").alias("n_copied"),
        F.size(F.filter(xs, lambda x: ~x["copied"] & x["live"])).cast("long").alias("n_live_owned"),
    )


def _located_sql(name: str, pattern: str, k: int) -> str:
    """Matches of one pattern with their places, from the pieces between them."""
    p = pattern.replace("'", "''")
    return rf"""
      {name}0 AS (SELECT doc_id, source, lang, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d),
      {name}1 AS (SELECT doc_id, source, lang, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM {name}0 WHERE len(ms) > 0),
      {name} AS (SELECT doc_id, source, lang, {k} AS k, m, (sum(length(g)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS s, (sum(length(g)) OVER w + sum(length(m)) OVER w)::BIGINT AS e
                 FROM {name}1 WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def secret_sql() -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    return rf"""
      WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
      {_located_sql("pa", secrets.ASSIGN, 0)}, {_located_sql("pb", secrets.ACCESS, 1)}, {_located_sql("pc", secrets.HEX, 2)}, {_located_sql("pd", "[A-Za-z0-9_-]{20,}", 3)},
      b AS (SELECT doc_id, source, lang, k, regexp_extract(m, '{assign}', 2) AS v, s, e FROM pa WHERE length(regexp_extract(m, '{assign}', 2)) >= 6
            UNION ALL SELECT doc_id, source, lang, k, m, s, e FROM pb UNION ALL SELECT doc_id, source, lang, k, m, s, e FROM pc),
      o AS (SELECT doc_id, source, lang, k, m AS v, s, e FROM pd WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
            AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = pd.doc_id AND b.s < pd.e AND pd.s < b.e)),
      c AS (SELECT *, length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM (SELECT * FROM b UNION ALL SELECT * FROM o)),
      f AS (SELECT v, count(DISTINCT source) >= {secrets.WIDE} OR count(DISTINCT concat_ws('/', source, lang)) >= {secrets.WIDE_REPOS} AS copied FROM c GROUP BY v),
      j AS (SELECT c.*, f.copied, ['assign', 'access', 'hex', 'opaque'][k + 1] || ':' || s || ':' || e AS x FROM c JOIN f USING (v)
            WHERE k < 3 OR (NOT f.copied AND live)),
      g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS bs,
                   string_agg(x, ',' ORDER BY s, k) AS xs, count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied AND live) AS n_live FROM j GROUP BY doc_id)
      SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(xs, '') AS spans,
             coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live_owned FROM d LEFT JOIN g USING (doc_id)"""


def op2_license_scan(spark, sf_dir):
    found = F.col("found")
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_units",
        F.size(found).cast("long").alias("n_matches"),
        F.array_join(F.transform(found, lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform(found, lambda x: x["dice"])).alias("best_dice"),
    )


def license_sql() -> str:
    """Every piece of every text against every template, without cue words."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ", ".join(f"({i}, '{n}', {quoted(g)}, {lo}, {hi})" for i, (n, g, lo, hi) in enumerate(licenses.template_rows()))
    around = ", ".join(f"('{w}', {o}, {n})" for w, o, n in licenses.anchors())
    words = lambda x: rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '')"
    return rf"""
      WITH t AS (SELECT * FROM (VALUES {rows}) AS v(i, license, grams, lo, hi)), a AS (SELECT * FROM (VALUES {around}) AS v(word, o, n)),
      d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
      q AS (SELECT r, doc_id, x, list_filter(list_transform(string_split_regex(x, '\n[ \t\r]*\n'), lambda y: regexp_replace(y, '^\n+|\n+$', '', 'g')), lambda y: regexp_matches(y, '[\p{{L}}\p{{N}}]')) AS ps FROM d),
      p AS (SELECT r, doc_id, x, list_concat(list_concat(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[\p{{L}}\p{{N}}]')), list_filter(ps, lambda y: contains(y, chr(10)))), CASE WHEN len(ps) > 1 THEN [x] ELSE [] END) AS us FROM q),
      f AS (SELECT r, {words("x")} AS ws FROM d), o AS (SELECT r, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM f),
      pieces AS (SELECT r, {words("u")} AS w FROM (SELECT r, unnest(us) AS u FROM p) UNION SELECT r, ws[greatest(pos - o0, 1):greatest(pos - o0, 1) + n - 1] FROM (SELECT o.*, a.o AS o0, a.n FROM o JOIN a USING (word)) AS o),
      g AS (SELECT r, row_number() OVER () AS k, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1])) AS b FROM pieces),
      m AS (SELECT r, k, license, i, round(2 * len(list_intersect(b, grams)) / (len(b) + len(grams)), 6) AS dice FROM g JOIN t ON len(b) BETWEEN lo AND hi),
      s AS (SELECT r, license, dice FROM m WHERE dice >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, i) = 1),
      z AS (SELECT r, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ls, max(dice) AS d FROM s GROUP BY r)
      SELECT p.doc_id, len(us)::BIGINT AS n_units, coalesce(n, 0)::BIGINT AS n_matches, coalesce(ls, '') AS licenses, d AS best_dice FROM p LEFT JOIN z USING (r)"""


def op4_personal_data(spark, sf_dir):
    xs = F.col("spans")
    of = lambda k: F.size(F.filter(xs, lambda x: x["k"] == k)).cast("long")
    base = F.filter(xs, lambda x: x["k"] < pii.BASE)
    return pii.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        of(0).alias("n_email"),
        of(1).alias("n_ip"),
        of(2).alias("n_card"),
        of(3).alias("n_phone"),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(xs).alias("spans"),
        F.size(F.filter(xs, lambda x: x["k"] >= pii.BASE)).cast("long").alias("n_added"),
    )


def op10_decontaminate(spark, sf_dir):
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    n_hit = decontaminate.hit_words(F.col("ranges"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def contamination_sql(documents: str = "documents") -> str:
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    ws = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
      WITH d AS (SELECT doc_id, {ws} AS ws FROM {documents}), b AS (SELECT item_id, {ws} AS ws FROM benchmark),
      iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g
             FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
      dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
             FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
      hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
      cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
      it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
      SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
             sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""


def op11_fill_in_middle(spark, sf_dir):
    cut = infill.transform(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def fill_in_middle_sql() -> str:
    h = lambda k: f"('0x' || d[{8 * k + 1}:{8 * k + 8}])::BIGINT"
    joined = lambda a, b: f"array_to_string(ts[{a}:{b}], '')"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    return rf"""
      WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{infill.SEED}:' || doc_id) AS d FROM documents),
      b AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM a),
      c AS (SELECT *, len(ts) AS n, least({h(0)} % (len(ts) + 1), {h(1)} % (len(ts) + 1)) AS x, greatest({h(0)} % (len(ts) + 1), {h(1)} % (len(ts) + 1)) AS y FROM b),
      f AS (SELECT *, CASE WHEN t = '' OR {marked} OR {h(2)} % 100 >= {infill.RATE} THEN 'plain' WHEN {h(3)} % 100 < {infill.SPM} THEN 'spm' ELSE 'psm' END AS form,
                   {joined(1, "x")} AS p, {joined("x + 1", "y")} AS m, {joined("y + 1", "n")} AS s FROM c)
      SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
             sha256(CASE form WHEN 'psm' THEN '{infill.PREFIX}' || p || '{infill.SUFFIX}' || s || '{infill.MIDDLE}' || m
                              WHEN 'spm' THEN '{infill.SUFFIX}' || s || '{infill.PREFIX}' || p || '{infill.MIDDLE}' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_license_scan": op2_license_scan, "op4_personal_data": op4_personal_data, "op5_quality_rules": op5_quality_rules, "op10_decontaminate": op10_decontaminate, "op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op1_secret_scan": secret_sql(), "op2_license_scan": license_sql(), "op5_quality_rules": quality_sql(), "op10_decontaminate": contamination_sql(), "op11_fill_in_middle": fill_in_middle_sql()}
