"""Conversations to turns: one row per turn, keyed by (conv_id, turn_idx), turn_idx from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import ROLE_NAMES, TRUST_OF_ROLE, lookup

TURN = "struct<id:string,role:string,text:string,source_trust:string,boundary_bypass:boolean>"


def role_name(role) -> F.Column:
    """user, assistant or system for all of their names; null for others."""
    return lookup(ROLE_NAMES, F.lower(F.btrim(role)))


def known_trust(trust) -> F.Column:
    x = F.lower(F.btrim(trust))
    return F.when(x.isin("trusted", "unknown", "untrusted"), x).otherwise(F.lit("unknown"))


def from_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns from a table with a row per turn; trust follows from the role, blank ids and roles get defaults."""
    role = F.coalesce(role_name(F.col(role_col)), F.lit("user"))
    return rows.where(F.col(text_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("int").alias("turn_idx"), F.format_string("T%03d", F.col(turn_col).cast("int") + 1).alias("turn_id"),
        role.alias("role"), F.col(text_col).alias("text"), lookup(TRUST_OF_ROLE, role, "unknown").alias("source_trust"), F.lit(False).alias("boundary_bypass"),
    )


def from_arrays(conversations: DataFrame, conv_col: str = "conv_id", turns_col: str = "turns") -> DataFrame:
    """Turns from an array of structs per conversation. Null elements and texts go; ids default to the place in the source."""
    placed = conversations.select(F.col(conv_col).alias("conv_id"), F.posexplode(turns_col).alias("place", "t")).where(F.col("t.text").isNotNull())
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1
    return placed.select(
        "conv_id", order.cast("int").alias("turn_idx"), F.coalesce(F.nullif(F.btrim("t.id"), F.lit("")), F.concat(F.lit("T"), (F.col("place") + 1).cast("string"))).alias("turn_id"),
        F.coalesce(F.nullif(F.lower(F.btrim("t.role")), F.lit("")), F.lit("user")).alias("role"), F.col("t.text").alias("text"), known_trust(F.col("t.source_trust")).alias("source_trust"), F.coalesce("t.boundary_bypass", F.lit(False)).alias("boundary_bypass"),
    )


def build_turns(messages, bypass: bool = False) -> F.Column:
    """array<TURN> from array<struct<role, text>>: blank texts go, then ids T001... by place; roles by their names."""
    kept = F.filter(messages, lambda m: F.btrim(m["text"]) != "")
    return F.transform(
        kept,
        lambda m, i: F.struct(
            F.format_string("T%03d", i + 1).alias("id"), role_name(m["role"]).alias("role"), F.btrim(m["text"]).alias("text"),
            lookup(TRUST_OF_ROLE, role_name(m["role"]), "unknown").alias("source_trust"), F.lit(bypass).alias("boundary_bypass"),
        ),
    )


def record_errors(turns) -> F.Column:
    """What is wrong with a conversation's array<TURN>: array of texts, empty if nothing."""
    each = F.flatten(
        F.transform(
            turns,
            lambda t, i: F.array(
                F.when(~F.coalesce(t["id"], F.lit("")).rlike(r"^T\d{3}$"), F.concat(F.lit("turn "), i.cast("string"), F.lit(": id"))),
                F.when(~F.coalesce(t["role"], F.lit("")).isin("user", "assistant", "system"), F.concat(F.lit("turn "), i.cast("string"), F.lit(": role"))),
                F.when(F.btrim(F.coalesce(t["text"], F.lit(""))) == "", F.concat(F.lit("turn "), i.cast("string"), F.lit(": text"))),
                F.when(~F.coalesce(t["source_trust"], F.lit("")).isin("trusted", "unknown", "untrusted"), F.concat(F.lit("turn "), i.cast("string"), F.lit(": source_trust"))),
            ),
        )
    )
    ids = F.transform(turns, lambda t: t["id"])
    whole = F.array(F.when(F.coalesce(F.size(turns), F.lit(0)) == 0, F.lit("no turns")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated turn id")))
    return F.filter(F.concat(whole, F.coalesce(each, F.array().cast("array<string>"))), lambda e: e.isNotNull())
