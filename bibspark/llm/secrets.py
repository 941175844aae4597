"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in one scan of the whole texts and kept as places and SHA-256 hashes, never as raw values.
The hashes are counted over distinct repositories and owners (map-side combined, first per repository, then per owner, then
per hash). A hash that `wide` owners or more share, or that stands in `wide_repos` repositories or more, is a widely copied
example; one held by fewer is owner-specific, and live-looking if its value mixes letters and digits over 16 characters or
more. Opaque tokens (20+ characters mixing both cases and digits) that no pattern names are added as spans of kind "opaque"
when they are owner-specific and live-looking.

Null and empty texts have no spans. Texts of any length, with any number of matches, take time linear in both. Null owners count
as one owner. Repeated rows and ties in doc_id keep a row each; `redact` joins spans by a hash of the text, on which alone they
depend, so ids may repeat or be null. An empty table gives no rows. Extra columns are ignored here and kept by `redact`, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, apart, cut, match_rows, pieces, side, text_key, without

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[a-z0-9_-]*+[A-Z])(?=[A-Z0-9_-]*+[a-z])[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
PATTERNS = (ASSIGN, ACCESS, HEX, OPAQUE)
BASE = 3
WIDE, WIDE_REPOS = 3, 12


def candidates(text: Column, k: int) -> Column:
    """The matches of pattern `k` in a text as array<struct<n,l,ok,hash,live>>."""
    t = F.coalesce(text, F.lit(""))

    def one(x: Column) -> Column:
        value = F.regexp_extract(x["m"], ASSIGN, 2) if k == 0 else x["m"]
        live = (F.char_length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        ok = F.char_length(value) >= 6 if k == 0 else F.lit(True)
        return F.struct(x["n"].alias("n"), F.char_length(x["m"]).alias("l"), ok.alias("ok"), F.sha2(value, 256).alias("hash"), live.alias("live"))

    found = F.transform(pieces(t, PATTERNS[k]), one)
    return F.when(F.contains(t, F.lit("AKIA")), found).otherwise(F.array().cast("array<struct<n:int,l:int,ok:boolean,hash:string,live:boolean>>")) if k == 1 else found


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_found) of candidates (hash, owner, repo)."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: Column | None = None, wide: int = WIDE, wide_repos: int = WIDE_REPOS, small: int = SMALL, keyed: bool = False) -> DataFrame:
    """(doc_id, spans): per row of `docs` its spans, array<struct<s,k,e,hash,live,n_owners,n_repos,copied>> by start, then kind.

    `repo` defaults to owner and language. The matches are written once, so the texts are read once; the ownership table is
    broadcast only if it takes at most `small` bytes, else joined by shuffle, where adaptive execution splits hot hashes.
    `keyed` adds the column text_key.
    """
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repo is None else repo
    key = [text_key(F.col(text)).alias("text_key")] if keyed else []
    arrays = [candidates(F.col(text), k).alias(f"c{k}") for k in range(len(KINDS))]
    found = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc"), *key, F.col(owner).alias("owner"), repo.alias("repo"), *arrays))
    rows = match_rows(found, [f"c{k}" for k in range(len(KINDS))], ["owner", "repo"]).where("ok")
    flat = cut(apart(rows, F.col("k") < BASE).drop("ok", "i"))
    counts = cut(ownership(flat))
    copied = (F.col("n_owners") >= wide) | (F.col("n_repos") >= wide_repos)
    judged = flat.join(side(counts, small), "hash").withColumn("copied", copied).where((F.col("k") < BASE) | (~copied & F.col("live")))
    span = F.struct("s", "k", "e", "hash", "live", "n_owners", "n_repos", "copied")
    per_row = judged.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,hash:string,live:boolean,n_owners:bigint,n_repos:bigint,copied:boolean>>")
    own = found.select("rid", F.col("doc").alias(doc_id), *(["text_key"] if keyed else []))
    return own.join(per_row, "rid", "left").withColumn("spans", F.coalesce("spans", empty)).drop("rid")


def listed(xs: Column) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", kind(x), x["s"], x["e"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]", doc_id: str = "doc_id", text: str = "text", small: int = SMALL, **kw) -> DataFrame:
    """`docs` with every found span replaced by `mask`; overlapping spans are replaced as one."""
    spotted = scan(docs, doc_id, text, small=small, keyed=True, **kw).where(F.size("spans") > 0)
    flat = spotted.select("text_key", "spans").dropDuplicates(["text_key"]).select("text_key", F.explode("spans").alias("x")).select("text_key", "x.s", "x.e")
    in_text = Window.partitionBy("text_key").orderBy("s", "e")
    reach = F.max("e").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    first = flat.withColumn("first", (F.coalesce(reach, F.lit(0)) <= F.col("s")).cast("int"))
    runs = first.withColumn("run", F.sum("first").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy("text_key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    marks = cut(one.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("marks")))
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(own)])
    at = F.col(f"own{own.index(text)}")
    joined = rows.withColumn("text_key", text_key(at)).join(side(marks, small), "text_key", "left")
    masked = F.when(F.col("marks").isNull(), at).otherwise(without(at, F.col("marks"), mask))
    return joined.select(*[(masked if c == text else F.col(f"own{i}")).alias(c) for i, c in enumerate(own)])
