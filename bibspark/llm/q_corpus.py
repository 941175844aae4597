"""Queries that write, encode or join whole corpora; SQL where it can say the result."""

from __future__ import annotations

from . import bpe, jaccard, spelling, substring, tokenfile, vectors, warc
from .common import UPPER, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_file(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_substring_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.encode_docs(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_warc_index(spark, sf_dir):
    done = warc.archive(table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark, sf_dir):
    return vectors.near(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_token_file": op3_token_file, "op6_substring_dedup": op6_substring_dedup, "op7_byte_bpe": op7_byte_bpe, "op8_jaccard_join": op8_jaccard_join, "op9_warc_index": op9_warc_index, "op12_spelling_variants": op12_spelling_variants, "op13_embedding_dedup": op13_embedding_dedup}
#: URL keys of well-formed addresses only, as the tables have.
WARC_SQL = r"""
  WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS url FROM pages),
  d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
  k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper,
          regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
          lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '\?([^#]*)', 1)) AS query,
          strftime(TIMESTAMP '2024-01-01' + to_seconds((page_id % 1000000000 + 1000000000) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM d),
  u AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END ||
          CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url_key FROM k)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
         CASE WHEN keeper <> page_id THEN keeper END AS refers_to, url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM u"""


def _checksums() -> str:
    """The 256 remainders of the byte-wise CRC-32."""
    table = list(range(256))
    for _ in range(8):
        table = [0xEDB88320 ^ (x >> 1) if x & 1 else x >> 1 for x in table]
    return "[" + ", ".join(map(str, table)) + "]::BIGINT[]"


def spelling_sql() -> str:
    """Near words by the strings that are left when one letter is taken out; checksums byte by byte."""
    return rf"""
      WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
      r AS (SELECT doc, run, count(*) AS k FROM (SELECT doc, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM d) GROUP BY doc, run),
      hx AS (SELECT doc, run, k, hex(encode(doc || ':' || run)) AS x FROM r WHERE length(run) >= {spelling.LEAST_CHARS}),
      byt AS (SELECT doc, run, k, list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)) AS bs FROM hx),
      cs AS (SELECT doc, run, k, xor(list_reduce(bs, lambda a, b: xor(a // 256, tb[xor(a, b) % 256 + 1])), 4294967295) AS h FROM byt, (SELECT {_checksums()} AS tb)),
      w0 AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM cs),
      w AS (SELECT word, sum(k)::BIGINT AS n FROM w0 WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
      gone AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
      pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b USING (i, rest) WHERE a.word <> b.word
                UNION SELECT g.word, w.word, w.n FROM gone g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM gone g JOIN w ON g.rest = w.word),
      best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
      f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * w.n THEN other END AS form, CASE WHEN m >= {spelling.RATIO} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
      up AS (SELECT word, form, word AS root FROM f UNION ALL SELECT up.word, f.form, f.word FROM up JOIN f ON up.form = f.word)
      SELECT f.word, n, n_near, f.form, form_n, up.root FROM f JOIN up ON f.word = up.word AND up.form IS NULL"""


def embedding_sql() -> str:
    return rf"""
      WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
      l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {vectors.LEAST}),
      r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
      c AS (SELECT x, min(y) AS low FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x),
      s AS (SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id FROM v LEFT JOIN k ON vec_id = k.x LEFT JOIN c ON vec_id = c.x)
      SELECT *, vec_id = component_id AS kept FROM s"""


ORACLES = {"op9_warc_index": WARC_SQL, "op12_spelling_variants": spelling_sql(), "op13_embedding_dedup": embedding_sql()}
