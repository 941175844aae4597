"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every statistic is an expression of the document's own text, so the plan is scan -> project: no shuffle, no user function.
Null and empty texts have no words and fail `n_words`. Extra columns pass through; the columns added here replace ones of
the same name. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, window_hashes, words

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have in is it of on that the this to was with you "
    "au aux avec ce dans de des du elle en est et il la le les pas pour qui que sur un une "
    "als auch auf das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "como con del el es lo los las más no o para por se su una y"
).split()

#: (metric, comparison that a kept document meets, bound). Metrics are the names in `METRICS`.
THRESHOLDS: tuple[tuple[str, str, float], ...] = (
    ("n_words", ">=", 20),
    ("n_words", "<=", 1_000_000),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 20.0),
    ("symbol_ratio", "<=", 0.10),
    ("stop_words", ">=", 2),
    ("dup_line_ratio", "<=", 0.50),
    ("repeat_word_ratio", "<=", 0.30),
)


def _repeat_words(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; `h` holds one hash per window start."""

    def covered(pos: Column) -> Column:
        return F.aggregate(
            F.transform(pos, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
        )

    def repeated(pairs: Column) -> Column:
        same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
        dup = F.filter(pairs, lambda p, k: same(p, F.get(pairs, k - 1)) | same(p, F.get(pairs, k + 1)))
        return let(F.sort_array(F.transform(dup, lambda p: p["i"])), covered)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated)).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c not in ("_words", "_win", "_lines")]
    split = docs.select(*keep, words(F.col(text)).alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    w = F.col("_words")
    hashed = split.withColumn("_win", window_hashes(F.transform(w, lambda x: F.xxhash64(x)), WINDOW))
    return hashed.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_win")),
            "n_stop_words": F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in STOP_WORDS]))).cast("long"),
        }
    ).drop("_words", "_win", "_lines")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


METRICS = {
    "n_words": lambda: F.col("n_words"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "word_chars"),
    "stop_words": lambda: F.col("n_stop_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
}


def compiled(thresholds=THRESHOLDS) -> Column:
    """The names of the rules a document breaks, as one array expression."""
    broken = []
    for metric, test, bound in thresholds:
        value = METRICS[metric]()
        ok = {">=": value >= bound, "<=": value <= bound, ">": value > bound, "<": value < bound}[test]
        broken.append(F.when(~ok, F.lit(f"{metric} {test} {bound:g}")))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """`statistics` plus broken_rules, base_failed and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = statistics(docs, text).withColumns({"broken_rules": compiled(thresholds), "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def filter_docs(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """The kept documents with their own columns.

    A kept row is generated once or not at all: a filter would be pushed below the statistics and compute them again in its condition.
    """
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))).alias("_once")
    own = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)], F.col(text).alias("_text"))
    judged = judge(renamed, thresholds, "_text").select(*[f"_own{i}" for i in range(len(own))], once)
    return judged.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(own)])
