"""Text functions. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..rules import DISTRESS_CUES, STOPWORDS

WHITE = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]"


def let(value, body) -> F.Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text) -> F.Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text, at, most: int) -> F.Column:
    """most characters from 20 before place at (from 0), squeezed."""
    return squeezed(F.substring(text, F.greatest(F.lit(0), at - 20) + 1, F.lit(most)))


def centred_excerpt(text, phrase, most: int) -> F.Column:
    """most characters around the phrase's first place, with dots where text is left out; without the phrase the text's beginning."""
    start = lambda i: F.greatest(F.lit(0), i - 1 - most // 2)
    found = let(
        F.position(phrase, F.lower(text)),
        lambda i: F.when(i > 0, F.concat(F.when(start(i) > 0, F.lit("...")).otherwise(F.lit("")), F.btrim(F.substring(text, start(i) + 1, F.lit(most))), F.when(start(i) + most < F.length(text), F.lit("...")).otherwise(F.lit("")))),
    )
    plain = F.btrim(text)
    return F.coalesce(found, F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, F.lit(1), F.lit(most - 3)), F.lit("..."))))


def content_words(text) -> F.Column:
    """Distinct words of three or more letters that aren't stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']{3,}"), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))


def has_distress_cue(text) -> F.Column:
    return let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, DISTRESS_CUES)), lambda c: F.contains(t, c)))


def digits(text) -> F.Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kebab(text) -> F.Column:
    return F.lower(F.regexp_replace(text, "([A-Z])", "-$1"))


def canonical_json(text) -> F.Column:
    """JSON text with its keys sorted at every level; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def short_digest(text) -> F.Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cjk_ratio(text) -> F.Column:
    visible = F.regexp_replace(text, r"\s", "")
    return F.try_divide(F.regexp_count(visible, F.lit(r"[\x{4e00}-\x{9fff}]")), F.length(visible))


def language_label(label) -> F.Column:
    x = F.lower(F.btrim(label))
    return F.when(x.startswith("zh"), F.lit("zh")).when(x.startswith("en"), F.lit("en")).when(x == "", F.lit("unknown")).otherwise(F.coalesce(x, F.lit("unknown")))


def case_text(turns) -> F.Column:
    """Lower-cased texts of an array of turns, one a line; null where all are blank."""
    return F.nullif(F.lower(F.btrim(F.array_join(F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))), "\n"), F.lit(" \n"))), F.lit(""))


def blank_to_null(text) -> F.Column:
    return F.nullif(F.btrim(text), F.lit(""))


# Scripts that tell a language, and frequent words of those written in Latin letters.
SCRIPTS = {"ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "ru": r"[\x{0400}-\x{04ff}]", "el": r"[\x{0370}-\x{03ff}]", "ar": r"[\x{0600}-\x{06ff}]", "he": r"[\x{0590}-\x{05ff}]", "th": r"[\x{0e00}-\x{0e7f}]", "hi": r"[\x{0900}-\x{097f}]"}
FREQUENT = {
    "en": "the of and to in is that for it with as was are this be".split(),
    "de": "der die das und nicht von mit den dem ein eine auf ist zu des".split(),
    "es": "el la los las de que y en un una por con para del se".split(),
    "fr": "le la les des et est une dans que pour qui sur au du ne".split(),
    "it": "il di che non per una sono con del della gli nel alla come anche".split(),
    "pt": "o os as um uma que do da em para com não dos por mais".split(),
    "nl": "de het een van en dat op te zijn met voor niet aan er om".split(),
}


def guess_language(text) -> F.Column:
    """Language of a text by its script, and of Latin letters by frequent words (ties: in FREQUENT's order); null where nothing tells it."""

    def of(low):
        visible = F.length(F.regexp_replace(low, r"\s", ""))
        share = lambda pattern: F.try_divide(F.regexp_count(low, F.lit(pattern)), visible)
        by_words = let(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), most_frequent)
        out = F.when(share(SCRIPTS["ja"]) >= 0.1, F.lit("ja")).when(share(r"[\x{4e00}-\x{9fff}]") >= 0.3, F.lit("zh"))
        for name, pattern in list(SCRIPTS.items())[1:]:
            out = out.when(share(pattern) >= 0.3, F.lit(name))
        return out.otherwise(by_words)

    def most_frequent(words):
        votes = F.array(*(F.struct(F.size(F.filter(words, lambda w: w.isin(*own))).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, own) in enumerate(FREQUENT.items())))
        return let(F.array_max(votes), lambda best: F.when(best["n"] > 0, best["name"]))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def detect_language(text, expected=None, *fallback) -> F.Column:
    """A label (zh, en, others) of the text. Chinese characters outweigh the guess; where English is expected, an odd guess of a text with letters and hardly a
    Chinese character counts as English; where Chinese is expected, a fifth of Chinese characters is enough. Texts that tell nothing take the first
    fallback that isn't blank; else unknown."""
    expected = language_label(F.lit(None).cast("string") if expected is None else expected)
    wanted = language_label(F.coalesce(*map(blank_to_null, fallback), F.lit(None).cast("string")))

    def judged(guess):
        cjk = F.coalesce(cjk_ratio(text), F.lit(0.0))
        label = language_label(guess)
        return (
            F.when(guess.isNull(), wanted)
            .when((label != "zh") & (cjk >= 0.3), F.lit("zh"))
            .when((expected == "en") & ~label.isin("en", "zh") & (cjk < 0.05) & text.rlike(r"\p{L}"), F.lit("en"))
            .when((expected == "zh") & (cjk >= 0.2), F.lit("zh"))
            .otherwise(label)
        )

    return let(guess_language(text), judged)
