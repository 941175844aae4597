"""BibTeX files, extraction JSON, reports, and table backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "struct<title:string,authors:array<string>,year:string,doi:string,raw_text:string>"
EXTRACTION = f"struct<file_name:string,reference_count:int,references:array<{REFERENCE}>>"


def read_bib(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, path, source): a row for each file, numbered in order of path; plain or gzip. Only the paths are sorted, the texts stay where they are read."""
    from pyspark.sql import Window

    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    numbers = files.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"))
    return files.join(numbers, "path").select("doc_id", "path", "source")


def read_toml(spark: SparkSession, *paths: str) -> dict[str, dict]:
    """Settings by path: policies, export profiles, registries. They are dimensions of a few rows, read through Spark's readers."""
    import tomllib

    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    return {r["path"]: tomllib.loads(r["value"]) for r in rows}


def profile_rows(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    """(profile, field_order, renames, indent, types) of export profiles read by `read_toml`, in order of name."""
    rows = [(x.get("profile", p), list(x.get("field_order", [])), dict(x.get("field_renames", {})), x.get("indent", "  "), list(x.get("supported_entry_types", []))) for p, x in settings.items()]
    return spark.createDataFrame(sorted(rows), "profile string, field_order array<string>, renames map<string,string>, indent string, types array<string>")


def repository_rows(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    """(id, aliases, name, archive_prefix, pattern, url_template) of repository registries; names count as aliases."""
    rows = [(r["id"], [r["full_name"], r.get("short_name", r["full_name"]), *r.get("aliases", [])], r["full_name"], r.get("archive_prefix"), r.get("identifier_pattern"), r.get("url_template")) for x in settings.values() for r in x.get("repositories", [])]
    return spark.createDataFrame(rows, "id string, aliases array<string>, name string, archive_prefix string, pattern string, url_template string")


def write_bib(documents: DataFrame, path: str) -> None:
    """Entries of (bibtex), a blank line after each."""
    documents.select(F.concat("bibtex", F.lit("\n")).alias("value")).write.text(path)


def extraction(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """`rows` with the known keys of an extraction result; the count is that of the references there are."""
    parsed = rows.withColumn("x", F.from_json(payload, EXTRACTION)).select("*", "x.file_name", F.coalesce("x.references", F.array().cast(f"array<{REFERENCE}>")).alias("references")).drop("x")
    return parsed.withColumn("reference_count", F.size("references"))


def report(outcomes: DataFrame) -> DataFrame:
    """One JSON line with the number of each outcome and their sum, which must be that of the rows."""
    counts = outcomes.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "ready").alias("ready"), F.count_if(F.col("outcome") == "manual_review").alias("manual_review"))
    checked = F.when(F.col("total") == F.col("ready") + F.col("manual_review"), F.col("total")).otherwise(F.raise_error(F.lit("outcomes don't add up")).cast("long"))
    return counts.select(F.to_json(F.struct(checked.alias("total"), "ready", "manual_review")).alias("value"))


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
