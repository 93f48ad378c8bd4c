"""A dataset test run in one plan: conversations of several sets are filtered, sampled by weight, analysed and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filtering, sampling
from ..operators.turns import from_arrays
from ..storage import saved
from . import risk


def run(conversations: DataFrame, weights: dict[str, int], size: int, rules: filtering.Filter = filtering.Filter(), config: risk.Config = risk.Config()) -> dict[str, DataFrame]:
    """conversations: conv_id, dataset, language, turns. -> filtered, sample, report, summary (per dataset: total, kept, sampled, GO and NO_GO)."""
    turns = from_arrays(conversations)
    filtered = saved(filtering.evaluate(turns, conversations.select("conv_id", "language"), rules).join(conversations.select("conv_id", "dataset"), "conv_id"), "filtered")
    sample = sampling.weighted_round_robin(filtered.where("bucket = 'primary'").select("conv_id", "dataset"), "dataset", "conv_id", weights, size)
    sample = saved(sample, "sample")
    report = risk.run(turns.join(F.broadcast(sample.select("conv_id")), "conv_id", "left_semi"), config).report  # `size` ids
    judged = filtered.join(report.select("conv_id", "decision"), "conv_id", "left")
    summary = judged.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(F.col("bucket") != "removed").alias("kept"), F.count("decision").alias("sampled"), F.count_if(F.col("decision") == "GO").alias("go"), F.count_if(F.col("decision") == "NO_GO").alias("no_go"))
    return {"filtered": filtered, "sample": sample, "report": report, "summary": summary.withColumn("pass_rate", F.round(F.try_divide("kept", "total"), 6))}
