"""Sources of conversations: Markdown transcripts, JSON, JSONL and Parquet in the known shapes, all to the columns of operators.turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.turns import TURN, build_turns

SPEAKER = r"(?i)^\s*(user|assistant|human|ai|system)\s*:\s*(.*)$"


def split_front_matter(body) -> F.Column:
    """struct(front, body): what stands between a first line `---` and the next one; without its end all is body."""
    pattern = r"(?s)\A\s*---[^\n]*\n(.*?\n)?---[^\n]*(?:\n(.*))?\z"
    whole = body.rlike(pattern)
    return F.struct(F.when(whole, F.coalesce(F.regexp_extract(body, pattern, 1), F.lit(""))).alias("front"), F.when(whole, F.regexp_extract(body, pattern, 2)).otherwise(body).alias("body"))


def parse_markdown(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Turns of Markdown transcripts: a speaker's line opens a turn, other lines go on with it, lines before the first speaker are left out. All sources are trusted.

    A document's lines stay in its own row: no shuffle."""
    from ..rules import ROLE_NAMES, lookup

    lines = F.split(split_front_matter(F.regexp_replace(F.col(body_col), "\r\n?", "\n"))["body"], "\n")
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")

    def step(turns, line):
        role = F.regexp_extract(line, SPEAKER, 1)
        opened = F.concat(turns, F.array(F.struct(role.alias("role"), F.regexp_extract(line, SPEAKER, 2).alias("text"))))
        last = F.element_at(turns, -1)
        longer = F.concat(F.slice(turns, 1, F.size(turns) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["text"], F.lit("\n"), line).alias("text"))))
        return F.when(role != "", opened).when(F.size(turns) == 0, turns).otherwise(longer)

    placed = docs.select(F.col(id_col).alias("conv_id"), F.posexplode(F.aggregate(lines, none, step)).alias("turn_idx", "t"))
    role = lookup(ROLE_NAMES, F.lower("t.role"))
    return placed.select("conv_id", "turn_idx", F.format_string("T%03d", F.col("turn_idx") + 1).alias("turn_id"), role.alias("role"), F.regexp_replace("t.text", r"\A\s+|\s+\z", "").alias("text"), F.lit("trusted").alias("source_trust"), F.lit(False).alias("boundary_bypass"))


def parse_yaml(front: str | None) -> tuple[dict, list[str]]:
    """Front matter of nested maps and scalars: (values, faults). Comments and unsafe keys are left out."""
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    faults: list[str] = []
    for number, line in enumerate((front or "").split("\n"), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        key, colon, value = text.partition(":")
        if not colon or not key.strip() or text.startswith("- "):
            faults.append(f"line {number} is no key and value")
            continue
        if key.strip() in ("__proto__", "constructor", "prototype"):
            faults.append(f"line {number} has an unsafe key")
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = yaml_scalar(value.strip())
        else:
            inner: dict = {}
            stack[-1][1][key.strip()] = inner
            stack.append((indent, inner))
    return out, faults


def yaml_scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    text = text.split(" #")[0].strip()
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of Parquet, JSON lines, JSON (an array, or an object with rows, data or items) or Markdown (path, body). kind: by the suffix if not given."""
    kind = kind or {"md": "markdown", "markdown": "markdown", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet"}.get(path.rstrip("/").rpartition(".")[2].lower(), "parquet")
    if kind == "parquet":
        return spark.read.option("mergeSchema", True).parquet(path)
    if kind == "markdown":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "jsonl":
        return reader.json(path)
    rows = reader.option("multiLine", True).json(path)
    for wrapper in ("rows", "data", "items"):
        if rows.columns == [wrapper]:
            return rows.select(F.explode(wrapper).alias("x")).select("x.*")
    return rows


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, faults with the line's text) of JSON lines."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    return rows.where("x._corrupt is null").select("x.*").drop("_corrupt"), rows.where("x._corrupt is not null").select(F.col("value").alias("line"))


def fixture_pairs(spark: SparkSession, folder: str, given: str = ".input.json", expected: str = ".expected.json") -> DataFrame:
    """name, input, expected (texts of the files) of a folder's pairs; a file without its partner is left out."""

    def named(suffix: str, column: str) -> DataFrame:
        files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("name"), F.col("value").alias(column))

    return named(given, "input").join(named(expected, "expected"), "name")


CONTRACT = "struct<id:string,role:string,text:string,sourceTrust:string,boundaryBypass:boolean>"


def contract_turns(text) -> F.Column:
    """array<TURN> of a JSON document: its `turns`, or those of `steps.input`; null where there are neither."""
    held = F.from_json(text, f"turns array<{CONTRACT}>, steps struct<input:struct<turns:array<{CONTRACT}>>>")
    own = F.coalesce(held["turns"], held["steps"]["input"]["turns"])
    return F.transform(own, lambda t: F.struct(t["id"].alias("id"), t["role"].alias("role"), t["text"].alias("text"), t["sourceTrust"].alias("source_trust"), t["boundaryBypass"].alias("boundary_bypass")))


def contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns of annotation inputs (JSON contracts, or Markdown transcripts by the suffix), and (conv_id) of files without usable turns."""
    from ..operators.turns import from_arrays

    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    files = spark.read.text(path, wholetext=True).select(name.alias("conv_id"), F.col("value").alias("body"), F.lower(F.col("_metadata.file_path")).rlike(r"\.(md|markdown)$").alias("marked"))
    turns = from_arrays(files.where("not marked").select("conv_id", contract_turns(F.col("body")).alias("turns"))).unionByName(parse_markdown(files.where("marked"), "conv_id", "body"))
    return turns, files.select("conv_id").join(turns.select("conv_id").distinct(), "conv_id", "left_anti")


# --- shapes of public conversation sets, to (conv_id, turns, meta)


def from_messages(rows: DataFrame, id_col: str, messages_col: str, role: str = "role", text: str = "content", meta: list[str] | None = None, bypass: bool = False) -> DataFrame:
    """An array of messages with a role and a text under the given names."""
    messages = F.transform(messages_col, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))
    made = F.map_filter(F.create_map(*(x for c in (meta or []) for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if meta else F.create_map().cast("map<string,string>")
    return rows.select(F.col(id_col).alias("conv_id"), build_turns(messages, bypass).alias("turns"), made.alias("meta"))


def from_history(rows: DataFrame, id_col: str, history_col: str, user: str = "user", bot: str = "bot") -> DataFrame:
    """An array of rounds, each a user's and an assistant's text."""
    pairs = F.flatten(F.transform(history_col, lambda h: F.array(F.struct(F.lit("user").alias("role"), h[user].alias("text")), F.struct(F.lit("assistant").alias("role"), h[bot].alias("text")))))
    return rows.select(F.col(id_col).alias("conv_id"), build_turns(F.filter(pairs, lambda m: m["text"].isNotNull())).alias("turns"))


def from_prompt(rows: DataFrame, id_col: str, prompt_col: str, response_col: str, placeholder: str = "(no response)", bypass: bool = False) -> DataFrame:
    """A prompt and its response; a placeholder stands for a missing response."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col(prompt_col).alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce(F.nullif(F.btrim(response_col), F.lit("")), F.lit(placeholder)).alias("text")))
    return rows.where(F.btrim(prompt_col) != "").select(F.col(id_col).alias("conv_id"), build_turns(pair, bypass).alias("turns"))


def shape_of(columns: list[str]) -> str:
    """Which of the known shapes a table has."""
    return next((kind for name, kind in (("conversations", "messages"), ("conversation", "messages"), ("messages", "messages"), ("history", "history"), ("turns", "turns"), ("prompt", "prompt")) if name in columns), "unknown")


def bio_spans(tokens: DataFrame, separator: str = " ") -> DataFrame:
    """id, kind, start, stop, value of entities in token tables (id, place, token, tag B-x / I-x / O); tokens are joined by the separator."""
    own = Window.partitionBy("id").orderBy("place")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.regexp_extract("tag", r"^[BI]-(.+)$", 1)
    rows = tokens.withColumn("kind", kind).withColumn("start", F.coalesce(F.sum(F.length("token") + len(separator)).over(before), F.lit(0)))
    opened = (F.col("kind") != "") & (F.col("tag").startswith("B-") | (F.coalesce(F.lag("kind").over(own), F.lit("")) != F.col("kind")))
    rows = rows.withColumn("entity", F.sum(opened.cast("int")).over(own)).where("kind <> ''")
    parts = F.array_sort(F.collect_list(F.struct("place", "token")))
    return rows.groupBy("id", "entity", "kind").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("token")).alias("stop"), F.array_join(F.transform(parts, lambda p: p["token"]), separator).alias("value")).drop("entity")


__all__ = ["TURN", "bio_spans", "contract_turns", "contracts", "fixture_pairs", "from_history", "from_messages", "from_prompt", "parse_markdown", "parse_yaml", "read", "read_checked", "shape_of", "split_front_matter"]
