"""Directory scans: report files, artifact trees, source trees, datasets whose paths carry values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import secret_findings

#: Folders that a source scan leaves out.
SKIPPED = (".git", "node_modules", "dist", "coverage", "__pycache__")


def path_part(path, back: int) -> F.Column:
    """A path's part, counted from its end (1: the file)."""
    return F.element_at(F.split(path, "/"), -back)


def reports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, document as VARIANT, kind, decision, state, generated_at) of a folder's *.json, without subfolders; unreadable files as (id, text)."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    rows = files.select(F.regexp_replace(path_part(F.col("_metadata.file_path"), 1), r"\.json$", "").alias("id"), F.col("value").alias("text"), F.try_parse_json("value").alias("doc"))
    field = lambda *paths: F.coalesce(*(F.try_variant_get("doc", p, "string") for p in paths))
    kind = F.coalesce(
        *(F.when(field(path).isNotNull(), F.lit(name)) for path, name in (("$.report.risk_status", "risk"), ("$.summary.match", "regression"), ("$.summary.processedCases", "batch"), ("$.findings", "gate"), ("$.kappa", "agreement"))), F.lit("unknown")
    )
    good = rows.where("doc is not null").select("id", "doc", kind.alias("kind"), field("$.decision", "$.summary.decision", "$.decisionLevel").alias("decision"), field("$.report.risk_status", "$.summary.status", "$.ps").alias("state"), field("$.generatedAt", "$.generated_at").alias("generated_at"))
    return good, rows.where("doc is null").select("id", "text")


def artifacts(spark: SparkSession, folder: str, explode_field: str, skip: str = "attack-info.json") -> DataFrame:
    """Elements of an array field in all *.json below a folder, with method, attack and model from the path; blank prompts go."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).schema(f"{explode_field} array<struct<index:long,goal:string,behavior:string,prompt:string,response:string,jailbroken:boolean>>").json(folder)
    path = F.col("_metadata.file_path")
    rows = files.where(path_part(path, 1) != skip).select(path_part(path, 3).alias("method"), path_part(path, 2).alias("attack"), F.regexp_replace(path_part(path, 1), r"\.json$", "").alias("model"), F.posexplode(explode_field).alias("place", "x"))
    return rows.where(F.btrim("x.prompt") != "").select("method", "attack", "model", "place", "x.*")


def partitioned(spark: SparkSession, folder: str, names: list[str], kind: str = "parquet") -> DataFrame:
    """Files below a folder with a column for each of the last folders' names (outermost first)."""
    rows = spark.read.option("recursiveFileLookup", True).format(kind).load(folder)
    path = F.col("_metadata.file_path")
    return rows.select("*", *(path_part(path, len(names) - i + 1).alias(n) for i, n in enumerate(names)))


def source_secrets(spark: SparkSession, folder: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Secret findings of all text files below a folder; files with a zero byte are binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    outside = ~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in skipped) + ")/")
    texts = files.where(outside & ~F.contains("content", F.lit(b"\x00"))).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
    return secret_findings(texts, "file")


def audit(spark: SparkSession, groups: dict[str, dict[str, list[str]]], base: str = "") -> tuple[DataFrame, str]:
    """groups: level (required or reference) -> group -> paths. -> (level, group, path, exists) rows and READY or NOT_READY, on whether all
    required paths exist. Paths may be of any file system that Spark reads."""
    session = spark._jvm.org.apache.hadoop.fs
    rows = []
    for level, named in groups.items():
        for group, paths in named.items():
            for p in paths:
                at = session.Path(f"{base}/{p}" if base else p)
                rows.append((level, group, p, bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))))
    ready = all(r[3] for r in rows if r[0] == "required")
    return spark.createDataFrame(rows, "level string, group string, path string, exists boolean"), "READY" if ready else "NOT_READY"
