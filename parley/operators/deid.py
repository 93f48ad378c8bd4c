"""De-identification of turns: spans, tokens numbered through a conversation, redacted text, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pii import PHONE_DIGITS_KEPT, skipped_spans, spans, token
from ..functions.text import let as _let
from ..functions.text import short_digest


def replacements(turns: DataFrame, detectors: list[str] | None = None, most_per_type: int | None = None, strategy: str = "indexed-token", keep_domain: bool = False, digits_kept: int = PHONE_DIGITS_KEPT) -> DataFrame:
    """One row per span: conv_id, turn_idx, type, start, stop, length, digest, number (through the conversation), replacement. The value itself isn't kept."""
    found = turns.select("conv_id", "turn_idx", F.explode(spans(F.col("text"), detectors, most_per_type)).alias("m"))
    number = F.row_number().over(Window.partitionBy("conv_id", "m.type").orderBy("turn_idx", "m.start"))
    return found.withColumn("number", number).select(
        "conv_id", "turn_idx", "m.type", "m.start", (-F.col("m.back")).alias("stop"), (-F.col("m.back") - F.col("m.start")).alias("length"), short_digest(F.col("m.value")).alias("digest"), "number",
        token(F.col("m.type"), F.col("m.value"), F.col("number"), strategy, keep_domain=keep_domain, digits_kept=digits_kept).alias("replacement"),
    )


def redact(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """turns with each row's span replaced; only the turns with spans are joined with them."""
    own = rows.groupBy("conv_id", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "replacement"))).alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spliced = F.aggregate(
        "_spans",
        start,
        lambda s, m: F.struct(m["stop"].cast("int").alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, m["start"] - s["at"]), m["replacement"]).alias("out")),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return turns.join(own, ["conv_id", "turn_idx"], "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(spliced)).drop("_spans").select(*turns.columns)


def counts_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "type").agg(F.count("*").alias("n"))


def skipped(turns: DataFrame, most_per_type: int, detectors: list[str] | None = None) -> DataFrame:
    """conv_id, turn_idx, type, skipped, finding: spans that most_per_type leaves in the text."""
    rows = turns.select("conv_id", "turn_idx", F.explode(skipped_spans(F.col("text"), detectors, most_per_type)).alias("type"))
    return rows.groupBy("conv_id", "turn_idx", "type").agg(F.count("*").alias("skipped")).withColumn("finding", F.concat(F.lit("audit-max-per-type-"), "type"))


# Parts of made-up names.
FIRST_NAMES, LAST_NAMES = ["Jordan", "Casey", "Avery", "Morgan", "Taylor"], ["Lee", "Chen", "Patel", "Wang", "Lin"]


def surrogate(kind, number) -> F.Column:
    """A made-up value of an entity's kind by number; other kinds: their name and the number in brackets."""
    n = number.cast("long")
    digits = lambda width: F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0"))
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    return (
        F.when(kind == "email", F.concat(F.lit("contact"), digits(4), F.lit("@example.org")))
        .when(kind == "phone", mobile(n))
        .when(kind == "url", F.concat(F.lit("https://example.org/profile/"), digits(4)))
        .when(kind == "address", F.concat((n + 100).cast("string"), F.lit(" Example Road, Austin, TX")))
        .when(kind == "name", F.concat(name(FIRST_NAMES, n), F.lit(" "), name(LAST_NAMES, F.floor(n / len(FIRST_NAMES)))))
        .when(kind == "id_num", F.concat(F.lit("ID-"), digits(8)))
        .otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("_"), digits(4), F.lit("]")))
    )


def mobile(number) -> F.Column:
    """A mobile number from a number's last eight digits."""
    last = F.right(F.lpad(number.cast("string"), F.greatest(F.lit(8), F.length(number.cast("string"))), F.lit("0")), F.lit(8))
    return F.concat(F.lit("09"), F.substring(last, 1, 2), F.lit("-"), F.substring(last, 3, 3), F.lit("-"), F.substring(last, 6, 3))


def materialized(rows: DataFrame) -> DataFrame:
    """rows: id, record (number), text, entities (array of start, stop, kind, by start, without overlaps) -> id, text with made-up values, truth (kind,
    detector, start, stop, value). A value beside a letter or digit gets a space between, and a phone number before a dot or comma one after it."""
    text, number = F.col("text"), F.col("record").cast("long")
    one = lambda place: F.substring(text, place, F.lit(1))
    truth = "array<struct<kind:string,detector:string,start:int,stop:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit("").alias("out"), F.expr(f"cast(array() as {truth})").alias("truth"))

    def step(s, e):
        def with_value(made):
            before = F.when(e["start"] > 0, one(e["start"])).otherwise("")
            after = one(e["stop"] + 1)
            value = F.concat(F.when(before.rlike(r"[\p{L}\p{N}]") & made.rlike(r"^[\p{L}\p{N}]"), F.lit(" ")).otherwise(""), made, F.when(after.rlike(r"[\p{L}\p{N}]") & made.rlike(r"[\p{L}\p{N}]$"), F.lit(" ")).otherwise(""))
            return F.struct(value.alias("value"), F.when((e["kind"] == "phone") & after.isin(".", ","), F.lit(" ")).otherwise("").alias("gap"))

        def joined(v):
            head = F.concat(s["out"], F.substring(text, s["at"] + 1, e["start"] - s["at"]))
            own = F.struct(e["kind"].alias("kind"), F.when(e["kind"].isin("email", "phone"), e["kind"]).alias("detector"), F.length(head).alias("start"), (F.length(head) + F.length(v["value"])).alias("stop"), v["value"].alias("value"))
            return F.struct(e["stop"].cast("int").alias("at"), (s["k"] + 1).alias("k"), F.concat(head, v["value"], v["gap"]).alias("out"), F.concat(s["truth"], F.array(own)).alias("truth"))

        return _let(_let(surrogate(e["kind"], number * 10 + s["k"]), with_value), joined)

    whole = F.aggregate("entities", start, step)
    return rows.select("id", _let(whole, lambda s: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))).alias("text"), s["truth"].alias("truth"))).alias("x")).select("id", "x.*")
