"""Data filter for conversations and texts: cleaning, noise, language routing, first-wins duplicates, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language, language_label, let


@dataclass(frozen=True)
class Filter:
    min_turn_chars: int = 10
    max_turn_chars: int = 10_000
    required_roles: tuple[str, ...] = ("user", "assistant")
    min_visible: int = 24
    max_char_share: float = 0.65
    min_alnum_share: float = 0.25
    spam_repeat: int = 8
    spam_unique: int = 2
    spam_keywords: tuple[str, ...] = ()
    spam_urls: int = 3
    primary: tuple[str, ...] = ("en",)
    secondary: tuple[str, ...] = ("zh",)


def prune_reason(text, c: Filter, keep_bad_encoding: bool = False) -> F.Column:
    """Why a turn is left out; null if it stays."""
    x = F.btrim(text)
    noisy = F.contains(x, F.lit("�")) | F.contains(x, F.lit("\x00"))
    out = F.when(~F.length(x).between(c.min_turn_chars, c.max_turn_chars), F.lit("turn_length_out_of_range"))
    return out if keep_bad_encoding else out.when(noisy, F.lit("encoding_noise"))


def most_common(values) -> F.Column:
    """How often the most frequent element of an array occurs: the longest run of the sorted array, in n log n."""
    runs = F.aggregate(F.array_sort(values), F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("most")), lambda s, x: let(F.when(s["v"] == x, s["n"] + 1).otherwise(F.lit(1)), lambda n: F.struct(x.alias("v"), n.alias("n"), F.greatest(s["most"], n).alias("most"))), lambda s: s["most"])
    return F.coalesce(runs, F.lit(0))


#: Characters of a partition into few classes; all others are one more class.
CLASSES = ["abcdefghABCDEFGH", "ijklmnopIJKLMNOP", "qrstuvwxyzQRSTUVWXYZ"]


def has_common_character(text, share: float) -> F.Column:
    """Whether some character makes up `share` of the text. Only where a whole class of characters does can one of it: usual texts are settled by
    counting classes, and only the rest have their characters sorted."""
    n = F.length(text)
    sizes = [n - F.length(F.translate(text, c, "")) for c in CLASSES]
    largest = F.greatest(*sizes, n - sum(sizes[1:], sizes[0]))
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(largest < share * n, F.lit(False)).otherwise(most_common(characters) >= share * n)


def has_repeated_words(text, least: int, distinct: int) -> F.Column:
    """Whether the text has `distinct` different words at most, one of them `least` times. A text whose first words differ more is settled by these."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))
    first = F.size(F.array_distinct(words(F.substring(text, 1, 400)))) - 1  # the last one may be cut
    return F.when(first > distinct, F.lit(False)).otherwise(let(words(text), lambda w: (F.size(F.array_distinct(w)) <= distinct) & (most_common(w) >= least)))


def noise_reason(text, c: Filter) -> F.Column:
    """Why a text is noise or spam; null if it isn't."""
    x = F.btrim(text)

    def of(v):
        n = F.length(v)
        urls = F.regexp_count(F.lower(x), F.lit("https?://"))
        keyword = F.exists(F.array(*map(F.lit, c.spam_keywords)), lambda k: F.contains(F.lower(x), k)) if c.spam_keywords else F.lit(False)
        return (
            F.when(n < c.min_visible, "too_short")
            .when(has_common_character(v, c.max_char_share), "repeated_character")
            .when(F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]", "")) / n < c.min_alnum_share, "few_letters")
            .when(has_repeated_words(x, c.spam_repeat, c.spam_unique), "repeated_word")
            .when(keyword & (urls >= c.spam_urls), "spam_links")
        )

    return let(F.regexp_replace(x, r"\s", ""), of)


def conversation_digest(turns) -> F.Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), F.btrim(t["text"]))), "\n"), 256)


def evaluate(turns: DataFrame, languages: DataFrame | None, c: Filter = Filter(), dedupe: bool = True, order_col: str = "conv_id") -> DataFrame:
    """turns: conv_id, turn_idx, role, text; languages: conv_id, language. -> conv_id, bucket (primary, chinese, removed), reason, language, digest, pruned_turns.

    A conversation is a duplicate if one with the same text was kept before it in order_col's order. The smallest kept key of each
    digest comes by aggregation, and conversations find out by their own key and digest whether it is theirs, so a text that a third of all
    share is no task of its own; conversations that aren't kept take no part. languages None: told from the texts."""
    if languages is None:
        languages = detected_languages(turns)
    judged = turns.withColumn("_reason", prune_reason(F.col("text"), c))
    noise = F.when(F.col("_reason").isNull() & F.col("role").isin("user", "assistant"), noise_reason(F.col("text"), c).isNotNull())
    kept = F.when(F.col("_reason").isNull(), F.struct("turn_idx", "role", "text"))
    whole = judged.withColumn("_noise", noise).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(kept)).alias("turns"), F.count("_reason").alias("pruned_turns"), F.min("_noise").alias("all_noise")
    )
    roles = F.transform("turns", lambda t: t["role"])
    lacking = F.size(F.array_except(F.array(*map(F.lit, c.required_roles)), roles)) > 0
    reason = F.when(lacking & (F.col("pruned_turns") > 0), "missing_required_roles_after_cleaning").when(lacking, "missing_required_roles").when(F.coalesce(F.col("all_noise"), F.lit(False)), "noise_or_spam")
    found = whole.join(languages.select("conv_id", language_label(F.col("language")).alias("_language")), "conv_id", "left")
    found = found.withColumn("reason", reason).withColumn("language", F.when(reason.isNull(), F.coalesce("_language", F.lit("unknown"))).otherwise("unknown")).withColumn("digest", F.when(reason.isNull(), conversation_digest(F.col("turns"))))
    routed = F.when(F.col("language").isin(*c.primary), "primary").when(F.col("language").isin(*c.secondary), "chinese")
    found = found.withColumn("_bucket", F.when(F.col("reason").isNull(), routed)).drop("turns", "all_noise", "_language")
    if dedupe:
        kept, rest = found.where(F.col("_bucket").isNotNull()), found.where(F.col("_bucket").isNull())
        first = kept.groupBy("digest").agg(F.min(order_col).alias(order_col)).withColumn("_is_first", F.lit(True))
        marked = kept.join(first, [order_col, "digest"], "left")
        found = marked.withColumn("reason", F.when(F.col("_is_first").isNull(), "duplicate_text_hash")).drop("_is_first").unionByName(rest)
    bucket = F.when(F.col("reason").isNull(), F.coalesce("_bucket", F.lit("removed"))).otherwise("removed")
    return found.select("conv_id", bucket.alias("bucket"), F.when(F.col("reason").isNull() & F.col("_bucket").isNull(), "unsupported_language").otherwise(F.col("reason")).alias("reason"), "language", "digest", "pruned_turns")


def detected_languages(turns: DataFrame, expected: str | None = None) -> DataFrame:
    """conv_id, language of each conversation, from its turns' texts (see text.detect_language)."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", F.btrim("text").alias("text")))).alias("t"))
    text = F.array_join(F.transform(F.filter("t", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    return whole.select("conv_id", detect_language(text, F.lit(expected).cast("string")).alias("language"))


def report(evaluated: DataFrame) -> DataFrame:
    """bucket, reason, n and their totals (nulls) by rollup."""
    return evaluated.rollup("bucket", "reason").agg(F.count("*").alias("n"), F.sum("pruned_turns").alias("pruned_turns"), F.grouping_id().alias("level"))


def first_of_each(rows: DataFrame, digest, order_col: str) -> DataFrame:
    """order_col of the first row of every digest."""
    return rows.select(digest.alias("digest"), order_col).groupBy("digest").agg(F.min(order_col).alias(order_col), F.count("*").alias("n_copies"))


__all__ = ["Filter", "conversation_digest", "evaluate", "first_of_each", "most_common", "noise_reason", "prune_reason", "report"]
