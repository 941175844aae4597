"""Identifiers of entries in all schemes, what URLs tell, preprints, work types, repositories, and ambiguities: expressions over an entry's own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .semantic import VENUE_FIELDS, first

# Fields whose values are identifiers, never rewritten.
RAW_IDENTIFIER_FIELDS = (
    "url doi file eprint arxiv archiveprefix eprinttype primaryclass eprintclass isbn isbn-10 isbn-13 issn eissn coden lccn pmid pmcid pubmed eid pid islrn articleno crossref archived"
).split()
# Work types by entry type.
WORK_TYPES = {
    "article": "article periodical", "conference": "inproceedings conference", "book": "book mvbook booklet collection mvcollection proceedings mvproceedings", "inbook": "inbook bookinbook suppbook",
    "incollection": "incollection suppcollection inreference", "thesis": "mastersthesis phdthesis thesis dbathesis eddthesis", "report": "techreport report mastersreport", "dataset": "dataset languageresource artifactdataset",
    "software": "software artifactsoftware", "web": "online webpage electronic internet www", "preprint": "preprint", "misc": "misc unpublished manual presentation patent standard underreview game video ieeetranbstctl",
}
IDENTIFIER = "array<struct<scheme:string,value:string,status:string,confidence:string>>"
#: An arXiv identifier anywhere in a text, after a URL or a prefix, or alone.
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*|^)([0-9]{4}\.[0-9]{4,5}|[a-z][a-z.-]*/[0-9]{7})(v[0-9]+)?(?:\.pdf)?(?![0-9])"


def is_raw_identifier(name: Column) -> Column:
    return F.lower(name).isin(*RAW_IDENTIFIER_FIELDS)


def named(name: str, fields: str = "fields") -> Column:
    """Trimmed texts of all fields of a name, in order."""
    found = F.filter(fields, lambda f: (F.lower(f["name"]) == name) & f["resolved"].isNotNull())
    return F.filter(F.transform(found, lambda f: F.trim(f["resolved"])), lambda v: v != "")


def arxiv_of(text: Column) -> Column:
    """struct<base, version> of the first arXiv identifier in a text, or null."""
    base = F.lower(F.regexp_extract(text, ARXIV, 1))
    return F.when(base != "", F.struct(base.alias("base"), F.nullif(F.regexp_extract(text, ARXIV, 2), F.lit("")).alias("version")))


def arxiv_full(a: Column) -> Column:
    return F.concat(a["base"], F.coalesce(a["version"], F.lit("")))


def repository_name() -> Column:
    return F.coalesce(*[F.get(named(n), F.lit(0)) for n in ("archiveprefix", "eprinttype", "repository")])


def _is_arxiv(name: Column) -> Column:
    return F.coalesce(F.lower(name).contains("arxiv"), F.lit(False))


def urls() -> Column:
    """Absolute http(s) URLs of the url fields."""
    return F.filter(named("url"), lambda u: u.rlike(r"^(?i:https?)://[^\s/]+\S*$"))


def identifiers() -> Column:
    """All identifiers of an entry, schemes in order, each value once: the first mention is kept."""

    def rows(values: Column, scheme: str, status: str, confidence: str = "high") -> Column:
        kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        return F.transform(kept, lambda v: F.struct(F.lit(scheme).alias("scheme"), v.alias("value"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))).cast(IDENTIFIER)

    each = lambda name, fn: F.transform(named(name), fn)
    arx = lambda v: arxiv_full(arxiv_of(v))
    repository = repository_name()
    maybe = F.when(repository.isNull() | _is_arxiv(repository), each("eprint", arx)).otherwise(F.array().cast("array<string>"))
    eprint = F.when(_is_arxiv(repository), rows(maybe, "arxiv", "normalized")).otherwise(rows(maybe, "arxiv", "normalized", "medium"))
    mentions = F.flatten(F.array(*[F.filter(named(n), lambda v: v.rlike("(?i)arxiv")) for n in ("journal", "journaltitle", "howpublished", "note")]))
    listed = F.concat(
        rows(each("doi", N.doi), "doi", "normalized"), rows(F.transform(urls(), N.doi), "doi", "inferred"), rows(each("isbn", N.isbn), "isbn", "normalized"), rows(each("issn", N.issn), "issn", "normalized"),
        rows(named("pmid"), "pmid", "explicit"), rows(named("pmcid"), "pmcid", "explicit"), rows(each("arxiv", arx), "arxiv", "normalized"), eprint,
        rows(F.transform(mentions, arx), "arxiv", "inferred"), rows(F.transform(urls(), arx), "arxiv", "inferred"), rows(each("url", arx), "arxiv", "inferred", "medium"),
    )
    same = lambda a, b: (a["scheme"] == b["scheme"]) & (F.lower(a["value"]) == F.lower(b["value"]))
    return F.filter(listed, lambda x, i: ~F.exists(F.slice(listed, 1, i), lambda y: same(x, y)))


def of_scheme(ids: Column, scheme: str) -> Column:
    return F.transform(F.filter(ids, lambda x: x["scheme"] == scheme), lambda x: x["value"])


def preprint(ids: Column) -> Column:
    """struct<repository, identifier, version, category>: a named repository other than arXiv with an eprint, else the first arXiv identifier."""
    repository, eprint = repository_name(), F.get(named("eprint"), F.lit(0))
    category = F.coalesce(F.get(named("primaryclass"), F.lit(0)), F.get(named("eprintclass"), F.lit(0)))
    a = arxiv_of(F.get(of_scheme(ids, "arxiv"), F.lit(0)))
    row = lambda r, i, v: F.struct(r.alias("repository"), i.alias("identifier"), v.alias("version"), category.alias("category"))
    other = F.when(eprint.isNotNull(), row(repository, eprint, F.lit(None).cast("string")))
    return F.when(repository.isNotNull() & ~_is_arxiv(repository), other).when(a.isNotNull(), row(F.lit("arXiv"), a["base"], a["version"]))


def contains_name(text: Column, name: Column) -> Column:
    """Whether a repository's name stands in a text between characters that are no letters or digits."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(F.trim(name)), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.coalesce((F.trim(name) != "") & F.regexp_like(F.lower(text), quoted), F.lit(False))


def explicit_type(entry_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kind, names in WORK_TYPES.items() for n in names.split() for x in (n, kind)])
    return F.coalesce(F.try_element_at(table, F.lower(entry_type)), F.lit("unknown"))


def described(entries: DataFrame) -> DataFrame:
    """`entries` with ids, preprint, venue and work_type. A preprint overrides miscellaneous types, and articles whose only venue is the repository and that have no DOI."""
    places = F.array(*[F.lit(v) for v in VENUE_FIELDS])
    venue = F.get(F.transform(F.array_sort(F.transform(F.filter("fields", lambda f: F.array_position(places, F.lower(f["name"])) > 0), lambda f: F.struct(F.array_position(places, F.lower(f["name"])).alias("r"), f["name_start"].alias("at"), f["resolved"].alias("v")))), lambda x: x["v"]), F.lit(0))
    out = entries.withColumn("ids", identifiers()).withColumns({"preprint": preprint(F.col("ids")), "venue": N.squeeze(venue), "given_type": explicit_type(F.col("entry_type"))})
    in_repository = F.col("venue").isNull() | F.when(F.col("preprint.repository") == "arXiv", _is_arxiv(F.col("venue"))).otherwise(contains_name(F.col("venue"), F.col("preprint.repository")))
    takes_over = F.col("preprint").isNotNull() & (F.col("given_type").isin("misc", "web", "unknown") | ((F.col("given_type") == "article") & in_repository & (F.size(of_scheme(F.col("ids"), "doi")) == 0)))
    return out.withColumn("work_type", F.when(takes_over, "preprint").otherwise(F.col("given_type")))


def repositories(described_: DataFrame, registry: DataFrame) -> DataFrame:
    """`described_` with the registered repository of its preprint where the registry's pattern accepts the identifier.

    `registry` has (alias, name, archive_prefix, pattern, url_template), aliases in lower case and once each. arXiv is left alone.
    Adds repository_known, repository_accepts, archive_prefix and repository_url.
    """
    other = F.when(F.col("preprint.repository") != "arXiv", F.lower(F.trim("preprint.repository")))
    joined = described_.withColumn("alias", other).join(registry, "alias", "left")
    ok = F.col("pattern").isNotNull() & F.regexp_like(F.col("preprint.identifier"), F.col("pattern"))
    link = F.when(ok, F.expr("replace(url_template, '{identifier}', preprint.identifier)"))
    out = joined.withColumns({"repository_known": F.col("alias").isNull() | F.col("name").isNotNull(), "repository_accepts": F.when(F.col("alias").isNotNull(), F.coalesce(ok, F.lit(False))), "repository_url": link})
    return out.withColumn("archive_prefix", F.when(F.col("repository_accepts"), F.col("archive_prefix"))).drop("alias", "name", "pattern", "url_template")


def ambiguities(described_: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, kind, values): several DOIs, arXiv identifiers or repositories, macros with several values, values without one."""
    ids = F.col("ids")
    several = lambda kind, values: F.when(F.size(F.array_distinct(values)) > 1, F.struct(F.lit(kind).alias("kind"), F.array_join(F.array_distinct(values), "|").alias("values")))
    names = F.flatten(F.array(*[named(n) for n in ("archiveprefix", "eprinttype", "repository")]))
    per_field = F.flatten(F.transform("fields", lambda f: F.array_compact(F.array(
        F.when(F.size(f["candidates"]) > 1, F.struct(F.lit("macro-candidates").alias("kind"), F.array_join(f["candidates"], "|").alias("values"))),
        F.when(F.size(f["unresolved"]) > 0, F.struct(F.lit("unresolved-value").alias("kind"), F.array_join(f["unresolved"], "|").alias("values"))),
    ))))
    listed = F.array_compact(F.array(several("multiple-dois", of_scheme(ids, "doi")), several("multiple-arxiv-identifiers", of_scheme(ids, "arxiv")), several("multiple-repositories", F.transform(names, lambda n: F.lower(n)))))
    return described_.select("doc_id", "entry_idx", F.explode(F.concat(listed, per_field)).alias("a")).select("doc_id", "entry_idx", "a.*")


def shredded(described_: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, what, position, scheme, value): contributors, identifiers and URLs of each record as rows with their places."""
    person = lambda role: F.transform(F.coalesce(first(role)["people"], F.array()), lambda p: F.struct(F.lit(role).alias("scheme"), p["raw"].alias("value")))
    ids = F.transform("ids", lambda x: F.struct(x["scheme"].alias("scheme"), x["value"].alias("value")))
    links = F.transform(urls(), lambda u: F.struct(F.lit("url").alias("scheme"), u.alias("value")))
    part = lambda what, values: described_.select("doc_id", "entry_idx", F.lit(what).alias("what"), F.posexplode(values).alias("position", "x")).select("doc_id", "entry_idx", "what", "position", "x.*")
    return part("contributor", F.concat(person("author"), person("editor"))).unionByName(part("identifier", ids)).unionByName(part("url", links))


def entry_source(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, source): the whole document where it holds one record, else the bytes of the entry."""
    many = entries.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = entries.select("doc_id", "entry_idx", "start", "end").join(many, "doc_id").join(docs.select("doc_id", F.col("source").alias("whole")), "doc_id")
    part = F.decode(F.substring(F.encode("whole", "utf-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "utf-8")
    return rows.select("doc_id", "entry_idx", F.when(F.col("n") == 1, F.col("whole")).otherwise(part).alias("source"))
