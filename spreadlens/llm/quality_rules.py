"""Risk-controlled quality rules: cutoffs certified on labelled documents by exact binomial bounds.

Every rule rejects a document when one of its measures passes a cutoff. The grid of cutoffs is fixed beforehand, so all
labelled documents serve as holdout. A cutoff is certified for a stratum when the number k of wrongly rejected good
documents among n makes P(X <= k | n, limit) no larger than alpha, divided by all the tests made (strata x rules x cutoffs):
the exact one-sided (Clopper-Pearson) bound on its false rejection rate is then below the limit. Each rule gets an equal
part of the allowed risk, so the rules together stay within `risk` for every stratum with confidence 1 - alpha. Of the
certified cutoffs the one that catches most bad documents, good ones counted `good_weight` times against it, is taken; ties
go to the mildest. A stratum with too few labels certifies nothing and rejects nothing beyond the base rules.

Everything is DataFrame work: the measures are array expressions inside a row, the rest aggregates one row per stratum.

Defined cases: NULL and empty texts have no words and fail the base rules; a NULL stratum counts as ''; a document labelled
more than once counts by its worst label, NULL labels are ignored; repeated rows are judged each; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.session import stored

# rule: (numerator, denominator, cutoffs in thousandths); a document is rejected when 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars", (10, 20, 30, 50, 75, 100, 150, 200, 300, 400)),
    "dup_lines": ("n_dup_lines", "n_words", (2, 5, 10, 15, 20, 30, 50, 75, 100, 150)),
    "repeats": ("n_repeat_words", "n_words", (50, 75, 100, 150, 200, 250, 300, 350, 400, 450)),
    "long_words": ("word_chars", "n_words", (7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000, 50000, 100000)),
    "few_words": ("-n_words", "1", (-200000, -150000, -125000, -100000, -90000, -80000, -75000, -70000, -60000, -55000)),
}
RISK, ALPHA, GOOD_WEIGHT = 0.05, 0.05, 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur at least twice.

    Windows are sorted with their places, so equal ones are neighbours; the places of repeated ones, sorted again, give
    the covered words: three each, less what overlaps the next.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<a:string,b:string,c:string,i:int>>"))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(w: Column) -> Column:
        last = F.size(w) - 1
        repeated = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: ((j > 0) & same(w[j], F.get(w, j - 1))) | ((j < last) & same(w[j], F.get(w, j + 1))),
        )
        return F.when(last > 0, F.array_sort(F.transform(repeated, lambda j: w[j]["i"])))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    return F.coalesce(c.let(F.array_sort(windows), lambda w: c.let(places(w), covered)), F.lit(0)).cast("long")


def measures_of(text: Column) -> Column:
    """A struct of the measures and base_failed, evaluated once per text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(c.WORD))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(body, c.SPACES, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            c.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    failed = lambda m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return c.let(c.let(c.words(text), measures), lambda m: m.withField("base_failed", failed(m)))


def _passes(rule: str, cutoff: Column, measure) -> Column:
    num, den, _ = RULES[rule]
    top = -measure(num[1:]) if num.startswith("-") else measure(num)
    return 1000 * top > cutoff * (F.lit(1) if den == "1" else measure(den))


def _most_errors(n: Column, limit: float, level: float) -> Column:
    """The largest k with P(X <= k | n, limit) <= level; -1 if even k = 0 exceeds it. Terms are summed as logarithms."""
    odds, miss = math.log(limit / (1 - limit)), math.log1p(-limit)
    first = n * F.lit(miss)
    start = F.struct(first.alias("term"), first.alias("total"), F.when(first <= math.log(level), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        total = F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= math.log(level), i).otherwise(acc["k"]).cast("long").alias("k"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(n * F.lit(limit)), F.lit(1)).cast("long")), start, step)["k"]


def certified_cutoffs(
    measures: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: float = RISK, alpha: float = ALPHA, good_weight: int = GOOD_WEIGHT
) -> DataFrame:
    """(stratum, cutoffs map rule -> cutoff) from measures (doc_id, stratum, _m) and labels (doc_id, quality)."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = measures.where("not _m.base_failed").join(worst, "doc_id").select(F.col(stratum).alias("stratum"), (F.col("_quality") > 0).alias("good"), "_m")
    n_strata = max(1, known.select("stratum").distinct().count())
    tests = n_strata * sum(len(r[2]) for r in RULES.values())
    grid = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), F.lit(cut).cast("long").alias("cutoff"), _passes(rule, F.lit(cut), lambda m: F.col(f"_m.{m}")).alias("hit"))
            for rule, (_, _, cuts) in RULES.items()
            for cut in cuts
        )
    )
    counted = (
        known.select("stratum", "good", F.explode(grid).alias("g"))
        .groupBy("stratum", "g.rule", "g.cutoff")
        .agg(
            F.sum(F.col("good").cast("long")).alias("n"),
            F.sum((F.col("good") & F.col("g.hit")).cast("long")).alias("wrong"),
            F.sum((~F.col("good") & F.col("g.hit")).cast("long")).alias("caught"),
        )
        .withColumn("gain", F.col("caught") - good_weight * F.col("wrong"))
        .where("gain > 0")
    )
    sure = counted.where(F.col("wrong") <= _most_errors(F.col("n"), risk / len(RULES), alpha / tests))
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def passes_rules(m: Column, cutoffs: Column) -> Column:
    """Whether a text with these measures passes the base rules and its stratum's cutoffs."""
    rejected = m["base_failed"]
    for rule in RULES:
        hit = _passes(rule, F.element_at(cutoffs, F.lit(rule)), lambda name: m[name])
        rejected = rejected | F.coalesce(hit, F.lit(False))
    return ~rejected


def _with_cutoffs(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`df` with its stratum's `_cutoffs`. They are read from a written table of one row per stratum, so Spark knows its size and
    broadcasts it only below its threshold."""
    known = cutoffs.select(F.col("stratum").alias("_of"), F.col("cutoffs").alias("_cutoffs"))
    return df.join(known, F.col("stratum") == F.col("_of"), "left").drop("_of")


def _measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), measures_of(F.col("text")).alias("_m"))
    return stored(rows, "measures")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """One row per document (doc_id, text, lang): doc_id, measures, base_failed, kept."""
    base = _measured(docs)
    cuts = stored(certified_cutoffs(base, labels, risk=risk, alpha=alpha), "cutoffs")
    kept = passes_rules(F.col("_m"), F.col("_cutoffs"))
    return _with_cutoffs(base, cuts).select("doc_id", *(f"_m.{m}" for m in MEASURES), "_m.base_failed", kept.alias("kept"))


def passing_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The documents that the rules keep, with exactly their columns. Measures are taken twice, for the cutoffs and for the
    verdict, since carrying them would write or shuffle every text."""
    cuts = stored(certified_cutoffs(_measured(docs), labels, risk=risk, alpha=alpha), "cutoffs")
    packed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_doc"), F.coalesce("lang", F.lit("")).alias("stratum"), "text")
    # One expression from text to verdict: as columns of their own, the measures would be evaluated at every mention.
    kept = c.let(measures_of(F.col("text")), lambda m: passes_rules(m, F.col("_cutoffs")))
    return _with_cutoffs(packed, cuts).where(kept).select("_doc.*")
