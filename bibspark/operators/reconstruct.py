"""Reconstruction: provider rows scored against references, trusted identifiers, one choice per reference by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resolve
from .storage import cut

# The priority of each provider, lower first.
PRIORITY = {"local": 0, "crossref": 10, "semantic_scholar": 20, "arxiv": 40}
DEFAULT_PRIORITY = 70
TRUSTED = 0.80


def priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), source), F.lit(DEFAULT_PRIORITY))


def scored(references: DataFrame, records: DataFrame, most: int = resolve.SHORTLIST, least: float = 0.0) -> DataFrame:
    """Candidates (ref_id, record_id, source, found_doi, score, consistent) of each reference with a score of `least` or more: records of
    the same title, else the `most` that share most search words, else the most similar of all, and those of the same DOI.

    An equal DOI scores 1; else the gestalt ratio of the titles and the author token Jaccard are weighed. Authors are compared first:
    they tell what the title must reach, and bounds on the ratio pass over most pairs. A candidate is consistent if years agree where
    both sides have one and, where the reference has authors, at least half of the author tokens are shared.
    """
    left = cut(references.select(F.col("ref_id").cast("long").alias("ref_id"), resolve.tokens(F.col("authors")).alias("mine"), "year", "doi", resolve.comparison_key("title").alias("key")))
    right = cut(records.select(F.col("record_id").cast("long").alias("record_id"), "source", resolve.comparison_key("title").alias("r_key"), resolve.tokens(F.col("authors")).alias("theirs"), F.col("year").alias("r_year"), F.col("doi").alias("r_doi")))
    names = [*left.columns, *right.columns]
    titled = left.where("key <> ''")
    exact = titled.join(right, F.col("key") == F.col("r_key"))
    rest = titled.join(right.select(F.col("r_key").alias("key")).distinct(), "key", "left_anti")
    worded = lambda df, i, k: df.withColumnRenamed(i, "id").withColumn("tokens", resolve.search_tokens(F.col(k)))
    lists = resolve.shortlists(worded(rest, "ref_id", "key"), worded(right, "record_id", "r_key"), most)
    listed = lists.withColumnRenamed("id", "ref_id").select(*left.columns, F.explode("found").alias("x")).select(*left.columns, "x.*").withColumnRenamed("id", "record_id")
    alone = rest.join(lists.select(F.col("id").alias("ref_id")), "ref_id", "left_anti")
    scan = resolve.best_of_keys(alone.select(F.col("ref_id").alias("id"), "key"), right.select(F.col("record_id").alias("id"), F.col("r_key").alias("key")))
    scan = scan.select(F.col("l").alias("ref_id"), F.col("r").alias("record_id")).join(left, "ref_id").join(right, "record_id")
    by_title = exact.select(*names).unionByName(listed.select(*names)).unionByName(scan.select(*names))
    same_doi = F.coalesce(F.col("doi") == F.col("r_doi"), F.lit(False))
    by_doi = left.join(right, F.col("doi") == F.col("r_doi")).select(*names)
    pairs = by_title.where(~same_doi).unionByName(by_doi)
    shared = F.size(F.array_intersect("mine", "theirs"))
    union = F.size("mine") + F.size("theirs") - shared
    both = (F.size("mine") > 0) & (F.size("theirs") > 0)
    year_ok = F.coalesce(F.col("year") == F.col("r_year"), F.lit(True))
    authors = pairs.withColumns({"same_doi": same_doi, "a": F.when(union == 0, F.lit(0.0)).otherwise(shared / union), "both": both, "unnamed": F.size("mine") == 0})
    # scores are rounded to six places, so titles are held to a little less
    wanted = F.when(F.col("same_doi"), 2.0).when(F.col("both"), (F.lit(least) - 0.3 * F.col("a")) / 0.7).otherwise(F.lit(least)) - 1e-5
    may = authors.withColumn("wanted", wanted).where("same_doi or wanted <= 1")  # no title reaches more than 1
    known = may.withColumn("t", resolve.similarity_at_least("key", "r_key", "wanted")).where("same_doi or t >= 0")
    score = F.round(F.when(F.col("same_doi"), 1.0).otherwise(resolve.citation_score(F.col("t"), F.col("a"), F.col("both"))), 6)
    out = known.select("ref_id", "record_id", "source", F.col("r_doi").alias("found_doi"), score.alias("score"), (year_ok & (F.col("unnamed") | (F.col("a") >= 0.5))).alias("consistent"))
    return out.where(F.col("score") >= least)


def best_by_provider(candidates: DataFrame) -> DataFrame:
    """Of each reference and provider the candidate of the highest score; ties go to the smaller id."""
    top = Window.partitionBy("ref_id", "source").orderBy(F.desc("score"), "record_id")
    return candidates.withColumn("n", F.row_number().over(top)).where("n = 1").drop("n")


def providers_to_ask(references: DataFrame, providers: DataFrame) -> DataFrame:
    """(ref_id, source, ord): every provider in order, but only arXiv for a reference that names an arXiv identifier."""
    named = F.coalesce(F.col("text").rlike(r"(?i)\barxiv\s*:\s*[0-9]{4}\.[0-9]{4,5}|arxiv\.org/(?:abs|pdf)/"), F.lit(False))
    listed = providers.agg(F.collect_list(F.struct("source", "ord")).alias("asked")).withColumn("one", F.lit(1))  # a registry of a few providers, one row
    rows = references.withColumn("one", F.lit(1)).join(listed, "one").withColumn("named", named)
    return rows.select("ref_id", "named", F.explode("asked").alias("p")).where(~F.col("named") | (F.col("p.source") == "arxiv")).select("ref_id", "p.source", "p.ord")


def prioritised(queries: DataFrame) -> DataFrame:
    """(ref_id, ord, text, place): a reference's queries with those that name an arXiv identifier first, else in their order."""
    named = F.coalesce(F.col("text").rlike(r"(?i)\barxiv\b"), F.lit(False))
    return queries.withColumn("place", F.row_number().over(Window.partitionBy("ref_id").orderBy((~named).cast("int"), "ord")))


def details_to_fetch(candidates: DataFrame, most: int = 3, enough: float = 0.90) -> DataFrame:
    """The best `most` basic results of each reference, up to and with the first whose score is `enough`."""
    order = Window.partitionBy("ref_id").orderBy(F.desc("score"), "record_id")
    ranked_ = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    done = F.max((F.col("score") >= enough).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranked_.withColumn("done", F.coalesce(done, F.lit(0))).where("done = 0").drop("done")


def local_match(pairs: DataFrame, least: float = TRUSTED) -> Column:
    """Whether a stored record is the reference: equal DOIs decide; else titles must be alike, years and authors not speak against it."""
    mine, theirs = resolve.tokens(F.col("authors")), resolve.tokens(F.col("r_authors"))
    year_ok = F.coalesce(F.col("year") == F.col("r_year"), F.lit(True))
    people_ok = (F.size(mine) == 0) | (F.size(theirs) == 0) | F.arrays_overlap(mine, theirs)
    return F.when(F.col("doi").isNotNull() & F.col("r_doi").isNotNull(), F.col("doi") == F.col("r_doi")).otherwise((F.col("t") >= least) & year_ok & people_ok)


def evidence(found: DataFrame) -> DataFrame:
    """`found` (..., wanted_doi, doi, title, t) with `accepted` and the reason why not: no DOI, another DOI, or another title."""
    reason = (
        F.when(F.col("doi").isNull(), "doi_missing").when(F.col("doi") != F.col("wanted_doi"), "doi_mismatch")
        .when(F.col("title").isNull(), "title_missing").when(F.col("t") < TRUSTED, "title_mismatch")
    )
    return found.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def group_score(pairs: DataFrame) -> DataFrame:
    """(l, r, score): the best citation score over every title of a record with every one of its author groups.

    `pairs` has (l, r, title, authors, titles, groups); a record has few titles and groups.
    """
    each = pairs.select("l", "r", "title", "authors", F.explode("titles").alias("one"), "groups").select("l", "r", "title", "authors", "one", F.explode_outer("groups").alias("group"))
    mine, theirs = resolve.tokens(F.col("authors")), resolve.tokens(F.array_join("group", " "))
    both = (F.size(mine) > 0) & (F.size(theirs) > 0)
    timed = each.withColumn("t", resolve.title_similarity("title", "one"))
    return timed.groupBy("l", "r").agg(F.round(F.max(resolve.citation_score(F.col("t"), resolve.jaccard(mine, theirs), both)), 6).alias("score"))


def first_final(attempts: DataFrame) -> DataFrame:
    """(ref_id, ord): the first attempt that is accepted and complete, unless an attempt before it has a conflict, which ends the search."""
    order = Window.partitionBy("ref_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    open_ = attempts.withColumn("stopped", F.coalesce(F.max(F.col("conflict").cast("int")).over(order), F.lit(0)))
    return open_.where("stopped = 0 and accepted and complete and not conflict").groupBy("ref_id").agg(F.min("ord").alias("ord"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates in order of provider priority, falling score, source and id."""
    order = Window.partitionBy("ref_id").orderBy(priority(F.col("source")), F.desc("score"), "source", "record_id")
    return candidates.withColumns({"rank": F.row_number().over(order), "status": resolve.status(F.col("score"))})


def trusted_doi(candidates: DataFrame) -> DataFrame:
    """(ref_id, doi): of each reference the DOI of its best consistent match."""
    good = candidates.where((F.col("score") >= TRUSTED) & F.col("consistent") & F.col("found_doi").isNotNull())
    return ranked(good).withColumn("first", F.row_number().over(Window.partitionBy("ref_id").orderBy("rank"))).where("first = 1").select("ref_id", F.col("found_doi").alias("doi"))


def selected(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref_id, outcome, record_id): ready with the first consistent match by priority, else manual_review."""
    top = ranked(candidates.where((F.col("score") >= TRUSTED) & F.col("consistent"))).where("rank = 1").select("ref_id", "record_id")
    return references.select("ref_id").join(top, "ref_id", "left").select("ref_id", F.when(F.col("record_id").isNull(), "manual_review").otherwise("ready").alias("outcome"), "record_id")


def conflicts(records: DataFrame) -> DataFrame:
    """(doi, field): fields on which providers disagree about one DOI."""
    field = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.lower("title").alias("v")), F.struct(F.lit("year").alias("field"), F.col("year").cast("string").alias("v"))))
    return records.where("doi is not null").select("doi", field.alias("f")).select("doi", "f.*").where("v is not null").groupBy("doi", "field").agg(F.countDistinct("v").alias("n")).where("n > 1").select("doi", "field")


def citation_key(authors: Column, year: Column, venue: Column, title: Column) -> Column:
    """surname-year-venue-concept as a slug; parts that are missing fall away."""
    surname = resolve.slug(F.substring_index(F.substring_index(authors, " and ", 1), ",", 1))
    concept = F.get(F.filter(F.split(resolve.slug(title), "-"), lambda w: (F.char_length(w) > 3) & ~w.isin("with", "from", "that", "using")), F.lit(0))
    return F.concat_ws("-", F.nullif(surname, F.lit("")), year.cast("string"), F.nullif(resolve.slug(venue), F.lit("")), concept)


def candidate_id(source: Column, record: Column) -> Column:
    """First 16 hex digits of the hash of the candidate's canonical JSON."""
    text = F.concat(F.lit('{"record_id": "'), record.cast("string"), F.lit('", "source": "'), source, F.lit('"}'))
    return F.substring(F.sha2(text, 256), 1, 16)
