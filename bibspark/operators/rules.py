"""Validation rules: filters and projections over an entry's fields that emit diagnostic rows, stamped by a policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .semantic import first, records

DIAGNOSTIC = "array<struct<code:string,start:bigint,end:bigint,replacement:string,applicability:string,group:int>>"
# The default policy, (code, severity, blocking, enabled), a row for each code that rules give.
POLICY = (
    ("BIB-SYNTAX-001", "error", True, True), ("BIB-SYNTAX-002", "warning", False, True), ("BIB-SYNTAX-004", "warning", False, True), ("BIB-SYNTAX-005", "warning", False, True),
    ("BIB-SYNTAX-006", "hint", False, True), ("BIB-SYNTAX-007", "warning", True, True), ("BIB-SYNTAX-009", "warning", False, True), ("BIB-SEMANTIC-001", "warning", False, True),
    ("BIB-SEMANTIC-002", "warning", False, True), ("BIB-SEMANTIC-003", "error", True, True), ("BIB-SEMANTIC-004", "error", True, True), ("BIB-SEMANTIC-005", "error", False, True),
    ("BIB-SEMANTIC-006", "error", True, True), ("BIB-SEMANTIC-007", "warning", True, True), ("BIB-SEMANTIC-008", "error", True, True), ("BIB-SEMANTIC-009", "error", True, True),
    ("BIB-SEMANTIC-010", "warning", False, True), ("BIB-SEMANTIC-011", "warning", False, True), ("BIB-SEMANTIC-012", "error", True, True), ("BIB-SEMANTIC-101", "warning", False, True),
    ("BIB-SEMANTIC-102", "warning", False, True), ("BIB-SEMANTIC-106", "error", True, True), ("LAB-ENTRY-003", "error", True, False), ("LAB-URL-001", "information", False, False),
)
# Fields a policy asks for, by entry type.
REQUIRED = {"article": ("author", "title", "journal", "year"), "inproceedings": ("author", "title", "booktitle", "year"), "misc": ("author", "title", "year")}
SEVERITY = {"error": 3, "warning": 2, "information": 1, "hint": 0}


def policy(spark: SparkSession, rows=POLICY) -> DataFrame:
    return spark.createDataFrame(list(rows), "code string, severity string, blocking boolean, enabled boolean")


def _emit(code: str, items: Column, start, end, replacement=None, applicability: str = "none") -> Column:
    new = replacement or (lambda f: F.lit(None).cast("string"))
    # items of one rule are numbered: edits of the same number are one fix
    return F.transform(items, lambda f, i: F.struct(F.lit(code).alias("code"), start(f).alias("start"), end(f).alias("end"), new(f).alias("replacement"), F.lit(applicability).alias("applicability"), i.alias("group"))).cast(DIAGNOSTIC)


def _when(code: str, condition: Column, start: Column, end: Column, replacement: Column | None = None, applicability: str = "none") -> Column:
    one = F.struct(F.lit(code).alias("code"), start.alias("start"), end.alias("end"), (F.lit(None).cast("string") if replacement is None else replacement).alias("replacement"), F.lit(applicability).alias("applicability"), F.lit(0).alias("group"))
    return F.when(condition, F.array(one)).otherwise(F.array()).cast(DIAGNOSTIC)


def entry_rules() -> Column:
    """All diagnostics that an entry shows by itself."""
    fields = F.col("fields")
    name = lambda f: F.lower(f["name"])
    repeated = F.filter(fields, lambda f, i: F.exists(F.slice(fields, 1, i), lambda g: name(g) == name(f)))
    quoted = F.filter(F.flatten(F.transform(fields, lambda f: f["atoms"])), lambda a: a["kind"] == "quoted")
    broken = F.filter(fields, lambda f: f["raw"].rlike(r"[\r\n]"))
    prefixed = F.filter(fields, lambda f: (name(f) == "doi") & (F.size(f["atoms"]) == 1) & f["resolved"].rlike(r"^(?i:https?://(?:dx\.)?doi\.org/|doi:\s*)10\.[0-9]{4,}/\S+$"))
    gap = F.filter(fields, lambda f: (f["equals_start"] - f["name_end"] != 1) | (f["value_start"] - f["equals_start"] != 2))
    last = F.try_element_at(fields, F.lit(-1))
    content = lambda f: F.get(f["atoms"], F.lit(0))
    lacks = lambda n: first(n).isNull()
    scholarly = F.col("entry_type").isin("article", "inproceedings")
    missing = F.when(lacks("title"), F.lit(True)).when(scholarly & (lacks("author") | (lacks("year") & lacks("date"))), F.lit(True)).otherwise(F.lit(False))
    return F.concat(
        _emit("BIB-SYNTAX-001", repeated, lambda f: f["start"], lambda f: f["end"], applicability="unsafe"),
        _emit("BIB-SYNTAX-002", F.filter(fields, lambda f: f["name"] != name(f)), lambda f: f["name_start"], lambda f: f["name_end"], name, "safe"),
        _when("BIB-SYNTAX-004", (F.size(fields) > 0) & ~F.col("trailing_comma"), last["end"], last["end"], F.lit(","), "safe"),
        _emit("BIB-SYNTAX-005", quoted, lambda a: a["start"], lambda a: a["content_start"], lambda a: F.lit("{"), "safe"),
        _emit("BIB-SYNTAX-005", quoted, lambda a: a["content_end"], lambda a: a["end"], lambda a: F.lit("}"), "safe"),
        _emit("BIB-SYNTAX-006", gap, lambda f: f["name_end"], lambda f: f["value_start"], lambda f: F.lit(" = "), "safe"),
        _emit("BIB-SYNTAX-009", broken, lambda f: f["value_start"], lambda f: f["value_end"], lambda f: F.regexp_replace(f["raw"], r"[ \t]*[\r\n][ \t\r\n]*", " "), "safe"),
        _emit("BIB-SEMANTIC-001", prefixed, lambda f: content(f)["content_start"], lambda f: content(f)["content_end"], lambda f: F.regexp_replace(f["resolved"], r"^(?i:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), "safe"),
        _when("BIB-SEMANTIC-003", missing, F.col("start"), F.col("end")),
    )


def in_entries(entries: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, entry_idx, keep..., code, start, end, replacement, applicability, group)."""
    return entries.select("doc_id", "entry_idx", *keep, F.explode(entry_rules()).alias("d")).select("doc_id", "entry_idx", *keep, "d.*")


def duplicates(entries: DataFrame, what: str) -> DataFrame:
    """Values that two or more records of a document share: (doc_id, value, n, first_entry, entries). `what` is key, doi or arxiv."""
    recs = records(entries)
    value = {"key": F.lower("citation_key"), "doi": F.col("doi"), "arxiv": F.col("arxiv")}[what]
    named = recs.select("doc_id", "entry_idx", value.alias("value")).where("value is not null")
    grouped = named.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("entry_idx").alias("first_entry"), F.sort_array(F.collect_list("entry_idx")).alias("entries"))
    return grouped.where("n > 1").withColumn("entries", F.array_join(F.transform("entries", lambda x: x.cast("string")), ","))


#: A finding of any rule; `value` is what records of a document must not share.
FOUND = "array<struct<code:string,start:bigint,end:bigint,replacement:string,applicability:string,group:int,detail:string,value:string>>"


def shared_values() -> Column:
    """Values of a record that no other record of its document should have, by the code of the rule: key, DOI, arXiv identifier."""
    arx = N.arxiv(first("eprint")["resolved"])
    none = F.lit(None)
    named = (("BIB-SEMANTIC-009", F.lower("citation_key")), ("BIB-SEMANTIC-010", N.doi(first("doi")["resolved"])), ("BIB-SEMANTIC-011", arx["base"]))
    each = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(c).alias("code"), none.cast("long").alias("start"), none.cast("long").alias("end"), none.cast("string").alias("replacement"), F.lit("none").alias("applicability"), F.lit(0).alias("group"), v.alias("detail"), v.alias("value"))) for c, v in named])
    return F.array_compact(each).cast(FOUND)


def found(entries: DataFrame, registry: DataFrame | None = None, url_policy: str = "discourage") -> DataFrame:
    """Findings of all rules, on syntax, meaning and shared values, by one projection over the entries: (doc_id, entry_idx, code, start, end,
    replacement, applicability, group, detail). Findings on meaning stand where their entry stands. A value that records share is found once,
    at the first of them. `registry` has the registered repositories; without one every repository counts as known."""
    from . import identity, semrules

    rows = identity.described(entries)
    rows = identity.repositories(rows, registry) if registry is not None else rows.withColumns({"repository_known": F.lit(True), "repository_accepts": F.lit(None).cast("boolean")})
    none = F.lit(None).cast("string")
    own = F.transform(entry_rules(), lambda d: F.struct(*[d[c].alias(c) for c in ("code", "start", "end", "replacement", "applicability", "group")], none.alias("detail"), none.alias("value"))).cast(FOUND)
    meant = F.transform(semrules.semantic_rules(url_policy), lambda d, i: F.struct(d["code"].alias("code"), F.col("start"), F.col("end"), none.alias("replacement"), F.lit("none").alias("applicability"), i.alias("group"), d["detail"].alias("detail"), none.alias("value"))).cast(FOUND)
    each = rows.select("doc_id", "entry_idx", F.explode(F.concat(own, meant, shared_values())).alias("d")).select("doc_id", "entry_idx", "d.*")
    same = Window.partitionBy("doc_id", "code", "value")
    counted = each.repartition("doc_id").withColumns({"n": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("entry_idx"))})
    return counted.where("value is null or (n > 1 and nth = 1)").drop("n", "nth", "value")


def stamped(diagnostics: DataFrame, rules: DataFrame) -> DataFrame:
    """Diagnostics of enabled rules with severity and blocking; the policy has a row for each code that counts."""
    return diagnostics.join(rules.where("enabled"), "code").drop("enabled")


def validate(entries: DataFrame, rules: DataFrame, registry: DataFrame | None = None, url_policy: str = "discourage") -> DataFrame:
    """Every diagnostic of every rule with its place in its document's order and its number among those of its code. Findings of one
    code, range and detail are one. The entries are read once."""
    at = [F.coalesce("start", F.lit(2**32 - 1)), F.coalesce("end", F.lit(2**32 - 1)), "code", "entry_idx"]
    doc, code = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "code")
    again = Window.partitionBy("doc_id", "entry_idx", "code", "start", "end", "detail", "replacement").orderBy("group")
    once = stamped(found(entries, registry, url_policy).withColumn("again", F.row_number().over(again)).where("again = 1").drop("again"), rules)
    return once.withColumns({"place": F.row_number().over(doc.orderBy(*at)), "ordinal": F.row_number().over(code.orderBy("entry_idx", *at)) - 1})


def missing_required(entries: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, missing): required fields that an entry lacks, in policy order. `required` has (entry_type, lname, ord).

    The policy, a row for each type, is what is broadcast: Spark knows no size of it, and left to itself may take the entries.
    """
    listed = required.groupBy("entry_type").agg(F.sort_array(F.collect_list(F.struct("ord", "lname"))).alias("wanted"))
    named = entries.select("doc_id", "entry_idx", "entry_type", F.transform("fields", lambda f: F.lower(f["name"])).alias("has")).join(F.broadcast(listed), "entry_type")
    absent = F.filter(F.transform("wanted", lambda x: x["lname"]), lambda n: ~F.array_contains("has", n))
    return named.select("doc_id", "entry_idx", absent.alias("m")).where(F.size("m") > 0).select("doc_id", "entry_idx", F.array_join("m", ", ").alias("missing"))


def decision(entries: DataFrame, diagnostics: DataFrame, minimum: str | None = "error", include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), allow_unresolved: bool = False) -> DataFrame:
    """(doc_id, n_blocking, unresolved, accepted): whether a document may be registered.

    A diagnostic blocks if its rule does, if it is as severe as `minimum`, or if its code is included and not excluded; one on unresolved
    meaning blocks unless that is allowed. A document is accepted if it has a record and nothing blocks.
    """
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    code, open_ = F.col("code"), F.col("code") == "BIB-SEMANTIC-008"
    blocks = F.col("blocking") | (rank[F.col("severity")] >= (9 if minimum is None else SEVERITY[minimum]))
    blocks = (blocks | code.isin(*include) & ~code.isin(*exclude)) if include else blocks
    blocks = blocks & ~open_ if allow_unresolved else blocks | open_
    judged = diagnostics.groupBy("doc_id").agg(F.count_if(blocks).alias("n_blocking"), F.coalesce(F.bool_or(open_), F.lit(False)).alias("unresolved"))
    n = F.coalesce("n_blocking", F.lit(0))
    return entries.select("doc_id").distinct().join(judged, "doc_id", "left").select("doc_id", n.alias("n_blocking"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"), (n == 0).alias("accepted"))
