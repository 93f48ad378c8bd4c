"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query -> (module, function).
MODULES = {
    "op1_licenses": ("licenses", "op1"),
    "op2_html": ("html", "op2"),
    "op3_token_files": ("token_files", "op3"),
    "op4_secrets": ("secrets", "op4"),
    "op5_near_copies": ("near_copies", "op5"),
    "op6_leaks": ("leaks", "op6"),
    "op7_quality": ("quality", "op7"),
    "op8_toxicity": ("toxicity", "op8"),
    "op9_language": ("language", "op9"),
    "op10_packing": ("packing", "op10"),
}


#: Further queries, for what SQL can express of an operator's result: name -> (query, columns).
PARTS = {
    "licences_base": ("op1_licenses", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]),
    "secrets_base": ("op4_secrets", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]),
    "quality_base": ("op7_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    "packing_lengths": ("op10_packing", ["doc_id", "n_tokens"]),
}


def _lazy(module: str, function: str):
    def query(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), function)(spark, sf_dir)

    return query


def _part(name: str, columns: list[str]):
    whole = _lazy(*MODULES[name])
    return lambda spark, sf_dir: whole(spark, sf_dir).select(*columns)


def packing_padding(spark, sf_dir):
    """The padding of all buckets together and the tokens packed: one row."""
    from pyspark.sql import functions as F

    return _lazy(*MODULES["op10_packing"])(spark, sf_dir).agg(F.sum("padding").alias("padding"), F.sum("n_tokens").alias("tokens"))


def queries() -> dict:
    return {name: _lazy(*where) for name, where in MODULES.items()} | {name: _part(*what) for name, what in PARTS.items()} | {"packing_padding": packing_padding}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return {"licences_base": oracle.LICENCES, "secrets_base": oracle.SECRETS, "quality_base": oracle.QUALITY, "packing_lengths": oracle.LENGTHS, "packing_padding": oracle.PADDING}
