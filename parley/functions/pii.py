"""Personal data: patterns, check digits, spans, tokens and redaction, all as Catalyst expressions.

Spans of one text are found by taking all matches of a pattern in order and adding up what lies between them: the pieces that
split() leaves and the matches that regexp_extract_all() finds alternate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import NATIONAL_ID_LETTERS, SENSITIVE_QUERY_KEYS
from .text import digits, let

# The patterns. EDGE is an ASCII word boundary, whatever letters stand around it.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
EMAIL = rf"(?i){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}"
PHONE = r"(?<![A-Za-z0-9.])(?:\+?[0-9][0-9\s()-]{6,}[0-9])(?![A-Za-z0-9.])"
IPV4 = rf"{EDGE}{OCTET}(?:\.{OCTET}){{3}}{EDGE}"
NATIONAL_ID = rf"{EDGE}[A-Z][12][0-9]{{8}}{EDGE}"
CARD = rf"{EDGE}[0-9][0-9 -]{{11,}}[0-9]{EDGE}"
QUERY_SECRET = rf"(?i)(?<=[?&](?:{'|'.join(SENSITIVE_QUERY_KEYS)})=)[^&#\s]+"
#: Detectors in the order that settles equal spans.
DETECTORS = {"email": EMAIL, "phone": PHONE, "ipv4": IPV4, "tw_national_id": NATIONAL_ID, "credit_card": CARD, "query_secret": QUERY_SECRET}
#: What a text must hold for a pattern to match at all: most texts are settled without the dear patterns.
HINTS = {"email": r"@[A-Za-z0-9.-]*\.[A-Za-z]", "phone": r"[0-9][0-9\s()-]{6}", "ipv4": r"[0-9]\.[0-9]{1,3}\.[0-9]", "tw_national_id": r"[A-Z][12][0-9]{8}", "credit_card": r"[0-9][0-9 -]{11}", "query_secret": r"(?i)[?&][a-z_]+="}
PHONE_DIGITS_KEPT = 2


def likely_phone(text) -> Column:
    return F.length(digits(text)).between(8, 15) & ~text.rlike(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")


def luhn_valid(text) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def national_id_valid(text) -> Column:
    """Letter code and nine digits, weights 1 9 8 7 6 5 4 3 2 1 1, divisible by ten."""
    code = F.position(F.substring(text, 1, 1), F.lit(NATIONAL_ID_LETTERS)) + 9
    digit = lambda i: F.substring(text, i, 1).cast("int")
    total = F.floor(code / 10) + 9 * (code % 10)
    for i, w in zip(range(2, 11), (8, 7, 6, 5, 4, 3, 2, 1, 1), strict=True):
        total = total + w * digit(i)
    return F.when(text.rlike("^[A-Z][12][0-9]{8}$"), total % 10 == 0).otherwise(F.lit(False))


def uniform_id_valid(text) -> Column:
    """Eight digits, weights 1 2 1 2 1 2 4 1, digits of the products added, divisible by ten (or one less where the seventh digit is 7)."""
    total = F.lit(0)
    for i, w in zip(range(1, 9), (1, 2, 1, 2, 1, 2, 4, 1), strict=True):
        p = F.substring(text, i, 1).cast("int") * w
        total = total + F.floor(p / 10) + p % 10
    return F.when(text.rlike("^[0-9]{8}$"), (total % 10 == 0) | ((F.substring(text, 7, 1) == "7") & ((total + 1) % 10 == 0))).otherwise(F.lit(False))


VALID = {"phone": likely_phone, "tw_national_id": national_id_valid, "credit_card": luhn_valid}


def matches_of(text, pattern: str) -> Column:
    """array<struct<start, stop, value>> of a pattern's matches, start from 0."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(v, g):
        return F.aggregate(
            F.arrays_zip(v.alias("v"), F.slice(g, 1, F.size(v)).alias("g")),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)").alias("found")),
            lambda s, x: F.struct(
                (s["at"] + x["g"] + F.length(x["v"])).cast("int").alias("at"),
                F.concat(s["found"], F.array(F.struct((s["at"] + x["g"]).cast("int").alias("start"), (s["at"] + x["g"] + F.length(x["v"])).cast("int").alias("stop"), x["v"].alias("value")))).alias("found"),
            ),
            lambda s: s["found"],
        )

    return F.when(~text.rlike(pattern), F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")).otherwise(let(values, lambda v: let(gaps, lambda g: placed(v, g))))


def spans(text, detectors: list[str] | None = None, most_per_type: int | None = None) -> Column:
    """array<struct<start, back (minus the end), det (detector's number), type, value>> of the text: by start, longest first, without overlaps; most_per_type
    of a type, if given (what is beyond: skipped_spans)."""
    kept = all_spans(text, detectors)
    return kept if most_per_type is None else let(kept, lambda k: F.filter(k, lambda m, i: _before(k, m, i) < most_per_type))


def skipped_spans(text, detectors: list[str] | None, most_per_type: int) -> Column:
    """Types of the spans that most_per_type leaves out, one for each."""
    return let(all_spans(text, detectors), lambda k: F.transform(F.filter(k, lambda m, i: _before(k, m, i) >= most_per_type), lambda m: m["type"]))


def _before(spans, m, i) -> Column:
    return F.size(F.filter(F.slice(spans, 1, i), lambda o: o["type"] == m["type"]))


def all_spans(text, detectors: list[str] | None = None) -> Column:
    parts = []  # the functions of a loop are applied in its own round
    for i, (kind, pattern) in enumerate(DETECTORS.items()):
        if detectors is None or kind in detectors:
            own = F.when(text.rlike(HINTS[kind]), matches_of(text, pattern)).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)"))
            if kind in VALID:
                own = F.filter(own, lambda m: VALID[kind](m["value"]))
            parts.append(F.transform(own, lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("back"), F.lit(i).alias("det"), F.lit(kind).alias("type"), m["value"].alias("value"))))
    none = F.expr("cast(array() as array<struct<start:int,back:int,det:int,type:string,value:string>>)")
    return F.aggregate(
        F.array_sort(F.concat(*parts)),
        F.struct(F.lit(-1).alias("cursor"), none.alias("kept")),
        lambda s, m: F.when(m["start"] < s["cursor"], s).otherwise(F.struct((-m["back"]).cast("int").alias("cursor"), F.concat(s["kept"], F.array(m)).alias("kept"))),
        lambda s: s["kept"],
    )


def token(kind, value, number, strategy: str = "indexed-token", fixed: str = "[REDACTED]", keep_domain: bool = False, digits_kept: int = PHONE_DIGITS_KEPT) -> Column:
    """What replaces a span."""
    if strategy == "fixed-token":
        return F.lit(fixed)
    base = F.concat(F.lit("["), F.upper(kind), F.lit("_"), number.cast("string"), F.lit("]"))
    out = base
    if digits_kept:
        out = F.when(kind == "phone", F.concat(base, F.lit("_*"), F.right(digits(value), F.lit(digits_kept)))).otherwise(out)
    if keep_domain:
        out = F.when(kind == "email", F.concat(base, F.lit("@"), F.element_at(F.split(value, "@"), 2))).otherwise(out)
    return out


# Forms of mobile numbers and addresses, and the mobile's own check.
MOBILE = r"^09[0-9]{2}-[0-9]{3}-[0-9]{3}$"
ADDRESS = r"^(臺北市|新北市|臺中市|臺南市|高雄市).+區.+路[0-9]+段[0-9]+號$"


def plain_luhn_valid(text) -> Column:
    """Twelve digits or more, nothing else, with a valid last one."""
    return F.when(text.rlike("^[0-9]{12,}$"), F.call_function("luhn_check", text)).otherwise(F.lit(False))


def valid_value(detector, value) -> Column:
    """Whether a generated value has its detector's form; unknown detectors: false."""
    checks = {"tw_national_id": national_id_valid, "tw_phone": lambda v: v.rlike(MOBILE), "credit_card": plain_luhn_valid, "address": lambda v: v.rlike(ADDRESS), "tw_uniform_id": uniform_id_valid}
    out = F.lit(False)
    for name, check in checks.items():
        out = F.when(detector == name, F.coalesce(check(value), F.lit(False))).otherwise(out)
    return out
