"""Profiles of tables: completeness, label counts, multi-label mappings, distributions, secret findings, latest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import matches_of

# Names and patterns of secrets in source texts.
SECRET_PATTERNS = {
    "gitlab-pat": r"\bglpat-[A-Za-z0-9\-_.]{20,}\b",
    "openai-key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "private-key-header": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "generic-secret-assignment": r"""(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[:=]\s*["']?[A-Za-z0-9_\-]{16,}""",
}


def integrity(rows: DataFrame, required: list[str]) -> DataFrame:
    """column, rows, missing (null or blank) and completeness, in one pass."""
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c).cast("string")) == "")
    one = rows.agg(F.count("*").alias("rows"), *(F.count_if(blank(c)).alias(f"_{c}") for c in required))
    flat = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("missing")) for c in required)))
    return one.select("rows", flat.alias("x")).select("x.column", "rows", "x.missing", F.round(F.try_divide(F.col("rows") - F.col("x.missing"), F.col("rows")), 6).alias("completeness"))


def require_columns(rows: DataFrame, required: list[str]) -> DataFrame:
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return rows


def label_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("label")).agg(F.count("*").alias("n"))


def mapping_counts(rows: DataFrame, mapped) -> DataFrame:
    """mapped: array of struct(axis, severity). Rows per axis, per severity and per pair, by grouping sets."""
    flat = rows.select(F.explode(mapped).alias("m")).select("m.axis", "m.severity")
    return flat.groupingSets([["axis"], ["severity"], ["axis", "severity"]], "axis", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def flag_profile(rows: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """flag, by...: positives and nulls, unpivoted."""
    flat = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("value")) for f in flags))).alias("x"))
    return flat.groupBy(*by, "x.flag").agg(F.count_if(F.col("x.value") > 0).alias("positives"), F.count_if(F.col("x.value").isNull()).alias("nulls"), F.count("*").alias("n"))


def distribution_check(rows: DataFrame, column: str, targets: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Share of each value against its target (value, target) and whether it is within tolerance."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    joined = targets.join(counts, "value", "left").fillna(0, ["n"]).crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all"))))  # one row
    share = F.coalesce(F.try_divide("n", "_all"), F.lit(0.0))
    return joined.select("value", "n", F.round(share, 6).alias("share"), "target", (F.abs(share - F.col("target")) <= tolerance + 1e-12).alias("within"))


def secret_findings(texts: DataFrame, id_col: str, text_col: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """id, line and column (from 1), pattern and the line's excerpt of all matches of each pattern in the whole text; a match may span lines and counts where it starts."""
    patterns = patterns or SECRET_PATTERNS
    any_of = F.col(text_col).rlike("|".join(f"(?:{p})" for p in patterns.values()))
    own = texts.where(any_of).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = F.concat(*(F.transform(matches_of(F.col("text"), p), lambda m: F.struct(F.lit(name).alias("pattern"), m["start"].alias("start"))) for name, p in patterns.items()))
    hits = own.withColumn("found", found).select("id", "text", F.explode("found").alias("h"))
    hits = hits.withColumn("before", F.substring("text", F.lit(1), F.col("h.start")))
    start = F.substring_index("before", "\n", -1)  # of the line
    line = F.concat(start, F.substring_index(F.substring("text", F.col("h.start") + 1, F.length("text")), "\n", 1))
    return hits.select("id", (F.regexp_count("before", F.lit("\n")) + 1).alias("line_no"), (F.length(start) + 1).alias("column_no"), "h.pattern", F.substring(F.btrim(line), 1, 120).alias("excerpt"))


def latest(reports: DataFrame, time_col: str, id_col: str, size: int = 50) -> DataFrame:
    return reports.orderBy(F.desc(time_col), F.asc(id_col)).limit(size)


def coverage(hits: DataFrame, rules: DataFrame, least: int = 5) -> DataFrame:
    """rule_id, positives, negatives and whether both reach `least`; hits: rule_id, expected, hit."""
    counted = hits.groupBy("rule_id").agg(F.count_if(F.col("expected") & F.col("hit")).alias("positives"), F.count_if(~F.col("expected") & ~F.col("hit")).alias("negatives"))
    return rules.select("rule_id").join(counted, "rule_id", "left").fillna(0).withColumn("covered", (F.col("positives") >= least) & (F.col("negatives") >= least))
