"""Operator 7, quality rules: cutoffs on text measures whose false rejection is bounded by exact binomial tests on labelled holdouts.

Every expression on the rows is a Catalyst expression; only the holdouts' counts (one row for each stratum, rule and cutoff) reach
the driver, where the binomial tails are summed.

Method. A rule is a measure and an ordered list of candidate cutoffs, fixed before labels are seen; a document is rejected
by it when the measure lies beyond the cutoff. For each stratum (a column's value, `lang` by default) the labelled good
documents are the holdout. With n of them, of which the cutoff rejects k, the hypothesis "the cutoff rejects more than
alpha / rules of good documents" is rejected if P(Binomial(n, alpha / rules) <= k) <= delta / (strata * rules). In a rule the
cutoffs are tested from the most lenient to the strictest and testing stops at the first that fails (fixed sequence), so the
family-wise error over all strata, rules and cutoffs is at most delta (Bonferroni over strata and rules). Of the certified
cutoffs the one with the best balance holds: its share of labelled bad documents rejected, less COST times that of good ones (the most
lenient of equals). A rule without a certified cutoff, or with no gain, rejects nothing in that stratum. So with confidence 1 - delta no stratum loses
more than alpha of its good documents through the method (the base limits come before it and aren't part of that bound:
documents that they fail are in no holdout).

Edge cases. Text null: no words, base_failed. Stratum null: a stratum of its own; strata without labels: base limits alone. doc_id null: measured and kept or not
like any other, never labelled. Repeated doc_ids: each row is judged by itself; labels that disagree count as bad. Empty
tables: empty results, no cutoffs. Extra columns don't matter: only the named ones are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, saved, words_col

#: Measures of the method and their candidate cutoffs, most lenient first; a document is rejected if its measure is over the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [1.5, 1.2, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bangs_per_word": [1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "same_word_share": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
ALPHA, DELTA, COST = 0.05, 0.05, 5.0
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Strata whose cutoffs are broadcast (five numbers each); more are joined by a shuffle.
BROADCAST_STRATA = 100_000


def _n_repeat_words(hashes) -> F.Column:
    """Words in windows of WINDOW words that occur twice or more in the text; windows are compared by 64-bit hashes of word hashes."""

    def doubled(h, k):  # hashes of 2k words each, from hashes of k words
        return F.zip_with(F.slice(h, 1, F.size(h) - k), F.slice(h, k + 1, F.size(h) - k), lambda a, b: F.xxhash64(a, b))

    def covered(w):  # w: the windows' hashes
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        pairs = let(placed, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i))))
        starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda q: q.isNotNull()))))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda s, i: F.struct((s.n + F.least(F.lit(WINDOW), i - s.at)).cast("int").alias("n"), i.cast("int").alias("at")),
            lambda s: s.n,
        )

    def counted(w):
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    windows = let(doubled(hashes, 1), lambda two: let(doubled(two, 2), lambda four: doubled(four, 4)))  # WINDOW is 8: three doublings
    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows, counted))


def _of_words(words) -> F.Column:
    last = lambda h: F.greatest(F.size(h) - 1, F.lit(0))

    def of_hashes(h):
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _n_repeat_words(h).cast("long").alias("n_repeat_words"),
            F.size(F.array_remove(F.zip_with(F.slice(h, 1, last(h)), F.slice(h, 2, last(h)), lambda a, b: a == b), False)).cast("long").alias("n_same"),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measure(docs: DataFrame, text_col: str = "text", to: str = "_quality") -> DataFrame:
    """docs with one more struct column of counts; whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_of = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def whole(of_words, of_lines):
        return F.struct(*(of_words[k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words", "n_same")), *(of_lines[k].alias(k) for k in ("n_lines", "n_dup_lines")), n_of(r"[^#*$%&|<>]+").alias("n_symbols"), n_of("[^!]+").alias("n_bangs"))

    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumn(to, let(let(words_col(F.col(text_col)), _of_words), lambda w: let(counted, lambda x: whole(w, x))))


def base_failed(m) -> F.Column:
    return (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > REPEAT_PERCENT * m.n_words)


def rule_values(m) -> dict[str, F.Column]:
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "symbols_per_word": share(m.n_symbols, m.n_words),
        "bangs_per_word": share(m.n_bangs, m.n_words),
        "same_word_share": share(m.n_same, m.n_words),
        "dup_line_share": share(m.n_dup_lines, m.n_lines),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in double precision."""
    if k >= n:
        return 1.0
    terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
    return min(1.0, math.fsum(math.exp(t) for t in terms))


def certify(counts: list[tuple], alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES) -> dict:
    """counts: (stratum, n_good, n_bad, [[good rejected, bad rejected] per cutoff] per rule in order). -> {stratum: {rule: cutoff}}."""
    certified: dict = {}
    each, level = alpha / len(rules), delta / max(1, len(counts) * len(rules))
    for stratum, n_good, n_bad, by_rule in counts:
        own = certified.setdefault(stratum, {})
        for (rule, cutoffs), rejected in zip(rules.items(), by_rule, strict=True):
            best = 0.0
            for cutoff, (good, bad) in zip(cutoffs, rejected, strict=True):
                if not n_good or good > each * n_good or binomial_tail(good, n_good, each) > level:
                    break
                gain = bad / max(1, n_bad) - COST * good / n_good
                if gain > best:
                    own[rule], best = cutoff, gain
    return certified


def fit(measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES, measures_col: str = "_quality") -> dict:
    """Cutoffs per stratum from every labelled row. One row of counts a stratum with labels comes to the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    m = F.col(measures_col)
    rows = measured.where(~base_failed(m)).select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum"), *(v.alias(k) for k, v in rule_values(m).items() if k in rules))
    joined = rows.join(known, "_id")
    good, bad = (F.col("_label") == 1), (F.col("_label") != 1)
    sums = [F.sum((w & (F.col(rule) > c)).cast("long")).alias(f"{rule}_{i}_{side}") for rule, cutoffs in rules.items() for i, c in enumerate(cutoffs) for side, w in (("g", good), ("b", bad))]
    found = joined.groupBy("_stratum").agg(F.sum(good.cast("long")).alias("n_good"), F.sum(bad.cast("long")).alias("n_bad"), *sums).collect()
    counts = [(r["_stratum"], r["n_good"], r["n_bad"], [[(r[f"{rule}_{i}_g"], r[f"{rule}_{i}_b"]) for i in range(len(cutoffs))] for rule, cutoffs in rules.items()]) for r in sorted(found, key=lambda r: str(r["_stratum"]))]
    return certify(counts, alpha, delta, rules)


def cutoff_rows(spark: SparkSession, cutoffs: dict, stratum_type: str, rules: dict[str, list[float]] = RULES) -> DataFrame:
    """Rows _of (the stratum), _cut (struct of the rules' cutoffs, null: none), one for each stratum with a certified cutoff."""
    numbers = [F.struct(F.lit(key).cast(stratum_type).alias("_of"), F.struct(*(F.lit(own.get(r)).cast("double").alias(r) for r in rules)).alias("_cut")) for key, own in cutoffs.items() if own]
    rows = F.array(*numbers) if numbers else F.array().cast(f"array<struct<_of:{stratum_type},_cut:struct<{','.join(f'{r}:double' for r in rules)}>>>")
    return spark.range(1).select(F.explode(rows).alias("_x")).select("_x.*")


def judged(measured: DataFrame, cutoffs: dict, stratum_col: str = "lang", measures_col: str = "_quality", to: str = "kept", rules: dict[str, list[float]] = RULES) -> DataFrame:
    """measured with a column that is true where no certified cutoff of the row's stratum rejects it and the base limits pass."""
    strata = cutoff_rows(measured.sparkSession, cutoffs, dict(measured.dtypes)[stratum_col], rules)
    few = len(cutoffs) <= BROADCAST_STRATA
    joined = measured.join(F.broadcast(strata) if few else strata, measured[stratum_col].eqNullSafe(strata["_of"]), "left")
    m = F.col(measures_col)
    rejects = [F.coalesce(value > F.col(f"_cut.{rule}"), F.lit(False)) for rule, value in rule_values(m).items() if rule in rules]
    # as an array, or the optimizer tests the base limits below the join and so measures every text twice
    passes = F.array(~base_failed(m), *(~x for x in rejects))
    return joined.withColumn(to, F.forall(passes, lambda x: x)).drop("_of", "_cut")


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that pass, with their own columns. Measures twice (once for the cutoffs, once to decide) so that no text is shuffled."""
    # saved, or the optimizer measures once for the filter and once more for the values
    held = saved(measure(docs.select(id_col, stratum_col, text_col), text_col).select(id_col, stratum_col, "_quality"), "quality")
    cutoffs = fit(held, labels, stratum_col, id_col)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    measured = measure(docs.select(own, F.col(text_col).alias("_text"), F.col(stratum_col).alias("_stratum")), "_text")
    return judged(measured.drop("_text"), cutoffs, "_stratum", to="_kept").where("_kept").select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    """Counts, base limits and verdict of every document."""
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = saved(measure(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "_quality"), "quality")
    m = F.col("_quality")
    found = judged(held, fit(held, labels))
    return found.select("doc_id", m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), m.n_dup_lines.alias("n_dup_lines"), m.n_repeat_words.alias("n_repeat_words"), base_failed(m).alias("base_failed"), "kept")
