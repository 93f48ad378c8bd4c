"""Synthetic inputs: a seeded batch of cases by risk level, personal data with valid check digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import national_id_valid, uniform_id_valid
from ..operators.deid import mobile
from ..operators.turns import TURN
from ..rules import NATIONAL_ID_LETTERS, SENSITIVE_QUERY_KEYS

# The generator's constants, and cases per risk level.
MULTIPLIER, INCREMENT, MODULUS, SEED = 1664525, 1013904223, 2**32, 20260306
CASES = {"Normal": 80, "Observe": 50, "Deviate": 40, "Alert": 30}
TRIGGERS = {"Normal": [], "Observe": ["ambiguous reference"], "Deviate": ["context drift", "role confusion", "intent misread"], "Alert": ["violence instruction", "crash loop"]}


def draws(n: int, seed: int = SEED) -> list[int]:
    """The first n states of the linear congruential generator."""
    out, state = [], seed
    for _ in range(n):
        state = (state * MULTIPLIER + INCREMENT) % MODULUS
        out.append(state)
    return out


def batch(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """200 two-turn cases: conv_id, expected (risk level), turns."""
    rows, states = [], iter(draws(sum(CASES.values()), seed))
    for risk, n in CASES.items():
        for i in range(n):
            number = next(states)
            words = f"case {number % 1000} " + " and ".join(TRIGGERS[risk])
            rows.append((f"{risk.lower()}-{i + 1:03d}", risk, [("T001", "user", words.strip(), "trusted", False), ("T002", "assistant", f"noted {number % 97}", "trusted", False)]))
    return spark.createDataFrame(rows, f"conv_id string, expected string, turns array<{TURN}>")


def personal_data(spark: SparkSession, n: int) -> DataFrame:
    """id, kind, value: national ids, cards and mobile numbers with valid check digits, by number."""
    i = F.col("id")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (i % 26 + 1).cast("int"), F.lit(1))
    head = F.concat(letter, (i % 2 + 1).cast("string"), F.lpad((i * 104729 % 10_000_000).cast("string"), 7, "0"))
    digit = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda v: national_id_valid(v))
    body = F.concat(F.lit("4"), F.lpad((i * 15485863 % 10**14).cast("string"), 14, "0"))
    card = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda v: F.call_function("luhn_check", v))
    mobile = F.concat(F.lit("09"), F.lpad((i * 32452843 % 10**8).cast("string"), 8, "0"))
    each = F.explode(F.array(F.struct(F.lit("tw_national_id").alias("kind"), F.element_at(digit, 1).alias("value")), F.struct(F.lit("credit_card").alias("kind"), F.element_at(card, 1).alias("value")), F.struct(F.lit("phone").alias("kind"), mobile.alias("value"))))
    return spark.range(n).select("id", each.alias("x")).select("id", "x.kind", "x.value")


# Card prefixes, cities with their districts, roads, and the sentences that hold a value.
CARD_PREFIXES = ["412345", "431298", "455612", "518923", "542301"]
CITIES = [("臺北市", ["中正區", "大安區", "信義區"]), ("新北市", ["板橋區", "中和區", "新店區"]), ("臺中市", ["西屯區", "北屯區", "南屯區"]), ("臺南市", ["中西區", "東區", "永康區"]), ("高雄市", ["前鎮區", "左營區", "三民區"])]
ROADS = ["忠孝東路", "中山路", "民生路", "建國路", "和平路", "光復路"]
SENTENCES = [
    ("twNationalId", "tw_national_id", "My Taiwan ID is ", ". Please keep it confidential."),
    ("phone", "tw_phone", "My Taiwan mobile number is ", ". Please redact it from the ticket."),
    ("creditCard", "credit_card", "Use credit card ", " for the test purchase and then mask it."),
    ("address", "address", "Ship the package to ", " and remove the address from the export log."),
    ("twUniformId", "tw_uniform_id", "Vendor uniform ID is ", ". Mask it before sharing the procurement sheet."),
]


def _one_of(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _last(i, width: int) -> F.Column:
    """The last `width` digits of a number, with zeros before it."""
    return F.right(F.lpad(i.cast("string"), F.greatest(F.lit(width), F.length(i.cast("string"))), F.lit("0")), F.lit(width))


def _with_check_digit(body, valid) -> F.Column:
    return F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), valid), 1)


def national_id(i) -> F.Column:
    letter = _one_of(sorted(NATIONAL_ID_LETTERS), i)
    return _with_check_digit(F.concat(letter, F.when(i % 2 == 0, "1").otherwise("2"), _last(i, 7)), national_id_valid)


def uniform_id(i) -> F.Column:
    return _with_check_digit(_last(i, 7), uniform_id_valid)


def credit_card(i) -> F.Column:
    body = F.substring(F.concat(_one_of(CARD_PREFIXES, i), F.lpad(i.cast("string"), F.greatest(F.lit(9), F.length(i.cast("string"))), F.lit("0"))), 1, 15)
    return _with_check_digit(body, lambda v: F.call_function("luhn_check", v))


def address(i) -> F.Column:
    districts = F.element_at(F.array(*(F.array(*map(F.lit, d)) for _, d in CITIES)), (i % len(CITIES) + 1).cast("int"))
    district = F.element_at(districts, (F.floor(i / len(CITIES)) % len(CITIES[0][1]) + 1).cast("int"))
    return F.concat(_one_of([c for c, _ in CITIES], i), district, _one_of(ROADS, i), (i % 6 + 1).cast("string"), F.lit("段"), (i + 100).cast("string"), F.lit("號"))


def personal_cases(spark: SparkSession, n: int) -> DataFrame:
    """n cases of each of five types: case_id, entity_type, detector_type, value, text, start, stop (the value's place, code points)."""
    i = F.col("id")
    made = {"tw_national_id": national_id(i), "tw_phone": mobile(i), "credit_card": credit_card(i), "address": address(i), "tw_uniform_id": uniform_id(i)}
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("entity_type"), F.lit(detector).alias("detector_type"), made[detector].alias("value"), F.lit(before).alias("before"), F.lit(after).alias("after")) for kind, detector, before, after in SENTENCES)))
    rows = spark.range(n).select("id", each.alias("x")).select("id", "x.*")
    start = F.length("before")
    return rows.select(F.format_string("tw-pii-%s-%04d", "entity_type", "id").alias("case_id"), "entity_type", "detector_type", "value", F.concat("before", "value", "after").alias("text"), start.alias("start"), (start + F.length("value")).alias("stop"))


def query_secret_cases(spark: SparkSession, n: int) -> DataFrame:
    """n URLs with a secret in their query, of the same columns."""
    i = F.col("id")
    before = F.concat(F.lit("https://example.com/callback?"), _one_of(SENSITIVE_QUERY_KEYS, i), F.lit("="))
    value = F.concat(F.lit("secret-"), F.lpad(i.cast("string"), F.greatest(F.lit(4), F.length(i.cast("string"))), F.lit("0")))
    return spark.range(n).select(F.format_string("pii-query_secret-%04d", "id").alias("case_id"), F.lit("sensitiveQueryKeys").alias("entity_type"), F.lit("query_secret").alias("detector_type"), value.alias("value"), F.concat(before, value, F.lit("&env=dev")).alias("text"), F.length(before).alias("start"), (F.length(before) + F.length(value)).alias("stop"))
