"""Rules on the meaning of records: identifiers, types, dates, names, macros, repositories, URLs, comments; one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import identity
from .semantic import first

# Entry types by work type.
EXPECTED = {"article": "article", "conference": "inproceedings", "preprint": "misc", "book": "book", "inbook": "inbook", "incollection": "incollection", "thesis": "phdthesis", "report": "techreport"}
FINDING = "array<struct<code:string,detail:string>>"


def date_conflict() -> Column:
    """Whether the date field names another year than the year field."""
    own, other = N.year(F.get(F.split(N.squeeze(first("date")["resolved"]), "[-/]"), F.lit(0))), N.year(first("year")["resolved"])
    return F.coalesce(own != other, F.lit(False))


def mismatched_type() -> Column:
    """The entry type that a record's work type asks for, if the entry has another one."""
    asked = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), F.col("work_type"))
    kept = ((F.col("work_type") == "book") & F.col("entry_type").isin("proceedings", "mvproceedings")) | ((F.col("work_type") == "thesis") & F.col("entry_type").isin("mastersthesis", "phdthesis", "thesis"))
    return F.when((asked != F.col("entry_type")) & ~kept, asked)


def findings(registered: DataFrame, url_policy: str = "discourage") -> DataFrame:
    """(doc_id, entry_idx, code, detail) of `identity.repositories` rows."""
    return registered.select("doc_id", "entry_idx", F.explode(semantic_rules(url_policy)).alias("d")).select("doc_id", "entry_idx", "d.*")


def semantic_rules(url_policy: str = "discourage") -> Column:
    """All findings on the meaning of an `identity.repositories` row: array<struct<code, detail>>."""
    ids = F.col("ids")
    one = lambda code, condition, detail: F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))).otherwise(F.array()).cast(FINDING)
    each = lambda code, values: F.transform(values, lambda v: F.struct(F.lit(code).alias("code"), v.cast("string").alias("detail"))).cast(FINDING)
    several = lambda scheme: F.array_distinct(identity.of_scheme(ids, scheme))
    may_be_arxiv = identity.repository_name().isNull() | F.lower(identity.repository_name()).contains("arxiv")
    prefixed = F.filter("fields", lambda f: (f["resolved"].rlike(r"(?i)^\s*arxiv:\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?\s*$")) & ((F.lower(f["name"]) == "arxiv") | ((F.lower(f["name"]) == "eprint") & may_be_arxiv)))
    bad_urls = F.array_except(identity.named("url"), identity.urls())
    unresolved = F.exists("fields", lambda f: F.size(f["unresolved"]) > 0)
    ambiguous = F.exists("fields", lambda f: F.size(f["candidates"]) > 1) | (F.size(several("doi")) > 1) | (F.size(several("arxiv")) > 1)
    message = F.when(F.col("work_type") == "unknown", "work type").when(date_conflict(), "date").when(unresolved, "value").when(ambiguous, "ambiguous")
    return F.concat(
        one("BIB-SYNTAX-007", F.size("comments") > 0, F.size("comments")),
        each("BIB-SEMANTIC-002", F.transform(prefixed, lambda f: F.trim(F.regexp_replace(f["resolved"], r"(?i)^\s*arxiv:\s*", "")))),
        one("BIB-SEMANTIC-004", mismatched_type().isNotNull(), mismatched_type()),
        one("BIB-SEMANTIC-005", F.size(several("doi")) > 1, F.array_min(several("doi"))),
        one("BIB-SEMANTIC-005", F.size(several("arxiv")) > 1, F.array_min(several("arxiv"))),
        one("BIB-SEMANTIC-006", first("author").isNotNull() & (F.size(F.coalesce(first("author")["people"], F.array())) == 0), F.lit(None)),
        one("BIB-SEMANTIC-007", date_conflict(), first("date")["resolved"]),
        one("BIB-SEMANTIC-008", message.isNotNull(), message),
        one("BIB-SEMANTIC-012", ~F.col("repository_known"), F.lit("not registered")),
        one("BIB-SEMANTIC-012", F.col("repository_known") & ~F.col("repository_accepts"), F.lit("pattern")),
        each("BIB-SEMANTIC-101", F.array_distinct(F.flatten(F.transform("fields", lambda f: f["unresolved"])))),
        each("BIB-SEMANTIC-102", F.transform(F.filter("fields", lambda f: F.size(f["candidates"]) > 1), lambda f: F.lower(f["name"]))),
        each("BIB-SEMANTIC-106", bad_urls),
        one("LAB-URL-001", (F.size(identity.named("url")) > 0) & F.lit(url_policy != "allow"), F.lit(url_policy)),
    )


def specials_through_macros(parsed: DataFrame) -> DataFrame:
    """(doc_id, macro, char, n_fields): specials in a macro's own text that fields of the document use, directly or through other macros.

    Usage edges go from name to name within a document; a breadth-first search over them stops when a round reaches nothing new.
    """
    from .storage import cut

    strings = parsed.where("kind = 'string'").select("doc_id", F.explode("fields").alias("f"))
    macro = lambda a: a["kind"] == "macro"
    edges = cut(strings.select("doc_id", F.lower("f.name").alias("user"), F.explode(names_used(F.col("f.raw"))).alias("macro")))
    fields = parsed.where("kind = 'entry'").select("doc_id", "entry_idx", F.posexplode("fields").alias("field_idx", "f"))
    reached = cut(fields.where(F.exists("f.atoms", macro)).select("doc_id", "entry_idx", "field_idx", F.explode(names_used(F.col("f.raw"))).alias("macro")).distinct())
    front = reached
    while True:
        step = front.withColumnRenamed("macro", "user").join(edges, ["doc_id", "user"]).select("doc_id", "entry_idx", "field_idx", "macro").distinct()
        front = cut(step.join(reached, ["doc_id", "entry_idx", "field_idx", "macro"], "left_anti"))
        if front.isEmpty():
            break
        reached = cut(reached.union(front))
    own = strings.select("doc_id", F.lower("f.name").alias("macro"), F.explode(F.array_distinct(F.regexp_extract_all("f.raw", F.lit(r"(?<!\\)([%&#_^$])"), F.lit(1)))).alias("char")).distinct()
    return reached.join(own, ["doc_id", "macro"]).groupBy("doc_id", "macro", "char").agg(F.count("*").alias("n_fields"))


def names_used(raw: Column) -> Column:
    """Names outside braces and quotes of a value, in lower case: its macros."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\{(?:[^{}]|\{[^{}]*\})*\}", " "), r'"[^"]*"', " ")
    return F.array_distinct(F.filter(F.split(F.lower(bare), r"[\s#]+"), lambda w: w.rlike("^[a-z]")))


def metadata_problems(rows: DataFrame) -> DataFrame:
    """`rows` (title, year, authors array) with `problem`: a blank title, a year out of 1000 to 2999, or a blank author."""
    problem = (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title").when(F.col("year").isNotNull() & ~F.col("year").between(1000, 2999), "year")
        .when(F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(F.trim(a), F.lit("")) == ""), "author")
    )
    return rows.withColumn("problem", problem)


def registry_problems(registry: DataFrame) -> DataFrame:
    """(id, problem) of a repository registry (id, aliases, pattern, url_template): ids and aliases of several rows, patterns, templates."""
    ids = registry.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    alias = registry.select("id", F.explode("aliases").alias("a")).select("id", F.lower(F.trim("a")).alias("a")).distinct()
    shared = alias.join(alias.groupBy("a").agg(F.countDistinct("id").alias("n")).where("n > 1"), "a").select("id", F.lit("alias conflict").alias("problem")).distinct()
    opened = lambda c, x: F.size(F.split(c, x)) - 1
    pattern = registry.where(opened(F.col("pattern"), r"(?<!\\)\(") != opened(F.col("pattern"), r"(?<!\\)\)")).select("id", F.lit("bad pattern").alias("problem"))
    template = registry.where(~F.col("url_template").contains("{identifier}") | ~F.col("url_template").rlike("^https?://")).select("id", F.lit("bad template").alias("problem"))
    return ids.unionByName(shared).unionByName(pattern).unionByName(template)


def inheritance_cycles(policies: DataFrame) -> DataFrame:
    """(profile): policies (profile, parent) that lead back to themselves.

    Whoever is still reached after as many steps as there are policies lies on a cycle. Steps double each round, so their number is
    the logarithm of that of the policies.
    """
    from .storage import cut

    reach = cut(policies.where("parent is not null").select("profile", F.col("parent").alias("at")).distinct())
    n, width = reach.count(), 1
    while width < n:
        reach = cut(reach.join(reach.select(F.col("profile").alias("at"), F.col("at").alias("next")), "at").select("profile", F.col("next").alias("at")).distinct())
        width *= 2
    return reach.select(F.col("at").alias("profile")).distinct().join(policies.select("profile").distinct(), "profile", "left_semi") if n else policies.select("profile").limit(0)
