"""Task files in, training sets and reports out. Readers name their schemas; rows that do not parse
are kept apart or skipped as each says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import RANGE_BYTES, array_elements

CANONICAL = ["sample_id", "video_paths", "question", "options", "answer", "task_metadata"]
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet or JSON files as one table, columns by name. Another suffix raises before anything is read."""
    kinds = {p.rsplit(".", 1)[-1] for p in paths}
    if bad := kinds - {"parquet", "json", "jsonl"}:
        raise ValueError(f"cannot read files of the kinds {sorted(bad)}")
    out = None
    for kind in sorted(kinds):
        own = [p for p in paths if p.endswith(f".{kind}")]
        reader = spark.read.schema(schema) if schema else spark.read
        part = reader.option("mergeSchema", "true").parquet(*own) if kind == "parquet" else reader.json(own)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, *, start: int = 0, limit: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of files that are one JSON array each, with source_file and source_index (the place in the
    array), and what the names of their folders say, as in partitioned tables. Files of any size are read by
    ranges (see `arrays`). A file whose root is no array, or a row that is no object, raises."""
    rows = array_elements(spark, path, start=start, limit=limit, range_bytes=range_bytes)
    folders = [c for c in rows.columns if c not in ("file", "source_index", "raw")]
    name = F.element_at(F.split("file", "/"), -1)
    row = F.when(F.trim("raw", F.lit(" \t\r\n")).startswith("{"), F.from_json("raw", schema)).otherwise(F.raise_error(F.concat(name, F.lit(": a row is not an object"))))
    return rows.select(name.alias("source_file"), "source_index", *folders, row.alias("_row")).select("source_file", "source_index", *folders, "_row.*")


def map_fields(raw: DataFrame, mapping: dict[str, str], *, file: Column, index: Column) -> DataFrame:
    """Source columns under canonical names; lists in the answer joined by commas; the file and index as task_metadata."""
    if unknown := set(mapping) - set(CANONICAL):
        raise ValueError(f"unknown canonical fields {sorted(unknown)}")
    cols = {c: F.col(mapping[c]) for c in CANONICAL if c in mapping}
    if "answer" in cols and isinstance(raw.schema[mapping["answer"]].dataType, T.ArrayType):
        cols["answer"] = F.array_join(cols["answer"], ",")
    meta = F.struct(file.alias("source_file"), index.alias("source_index"))
    return raw.select(*[v.cast("string").alias(c) if c == "sample_id" else v.alias(c) for c, v in cols.items()], meta.alias("task_metadata"))


def unify_video_fields(df: DataFrame, *, legacy: tuple[str, ...] = ("segments", "scripts", "video_scripts", "synthesized_videos")) -> DataFrame:
    """`videos` from itself or the first legacy column that has a value; status: skipped, modified or error."""
    have = [c for c in legacy if c in df.columns]
    found = F.coalesce("videos", *have)
    status = F.when(F.col("videos").isNotNull(), "skipped").when(found.isNotNull(), "modified").otherwise("error")
    return df.withColumn("status", status).withColumn("videos", found).drop(*have)


def status_report(df: DataFrame, *, task: str) -> DataFrame:
    return df.groupBy(task).pivot("status", ["modified", "skipped", "error"]).count().na.fill(0)


TOOL_ENTRY = T.StructType([
    T.StructField("turn", T.LongType()), T.StructField("tool_name", T.StringType()), T.StructField("call_id", T.StringType()), T.StructField("timestamp_start", T.StringType()), T.StructField("timestamp_end", T.StringType()),
    T.StructField("inputs", T.StructType([T.StructField("observation_targets", T.ArrayType(T.StringType())), T.StructField("focus_prompt", T.StringType())])), T.StructField("output_raw", T.StringType())])


def read_tool_logs(spark: SparkSession, root: str, name: str = "tools_execution.json") -> DataFrame:
    """One row per tool call of all logs below a folder: task_id (leading digits of the log's folder), dir
    and the entry's fields. Files that are no list, and entries that are no object, give none."""
    rows = array_elements(spark, root, glob=name, strict=False)
    rows = rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("dir"), F.from_json("raw", TOOL_ENTRY).alias("e"), F.trim("raw", F.lit(" \t\r\n")).startswith("{").alias("ok")).filter("ok")
    return rows.select(F.regexp_extract("dir", r"^(\d+)", 1).try_cast("long").alias("task_id"), "dir", "e.*")


def read_jsonl_by_id(lines: DataFrame, *, line: str, order: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """JSON lines keyed by id, the last of each; blank and malformed lines are skipped."""
    parsed = lines.filter(F.trim(line) != "").select(F.col(order).alias("_o"), F.from_json(line, schema).alias("r")).filter(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "_o").alias("r")).select("r.*")


def training_rows(tasks: DataFrame, *, source: str, key: str, question: str, options: Column, answer: str, videos: Column, first: int | None = None) -> DataFrame:
    """data_source, agent_name, prompt, ability, reward_model and extra_info, for the first N rows of each source."""
    rows = tasks
    if first is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(key))).filter(F.col("_r") <= first).drop("_r")
    content = F.concat(F.col(question), F.lit("\n"), F.array_join(options, "\n"))
    return rows.select(
        F.col(source).alias("data_source"), F.lit("tool_agent").alias("agent_name"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"), F.lit("video_reasoning").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth")).alias("reward_model"),
        F.struct(F.col(source).alias("task_name"), F.col(key).cast("string").alias("task_id"), F.to_json(videos).alias("videos"), F.col(question).alias("original_question")).alias("extra_info"))


def training_messages(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: messages in order. Conversations without an assistant turn are empty."""
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("_t"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return rows.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def sft_export(samples: DataFrame, *, messages: str, correct: str, metadata: list[str], only_correct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of messages and metadata, one row of counts: exported, skipped_incorrect, skipped_empty)."""
    wrong = F.lit(only_correct) & ~F.coalesce(F.col(correct), F.lit(False))
    empty = ~F.exists(messages, lambda m: m["role"] == "assistant")
    counts = samples.agg(F.count_if(~wrong & ~empty).alias("exported"), F.count_if(wrong).alias("skipped_incorrect"), F.count_if(~wrong & empty).alias("skipped_empty"))
    return samples.filter(~wrong & ~empty).select(F.col(messages).alias("messages"), F.struct(*metadata).alias("metadata")), counts


def trajectory_summary(samples: DataFrame, *, task: str, correct: str, diagnosed: str) -> DataFrame:
    """total, correct, incorrect and with_diagnosis per task and over all (task null)."""
    ok = F.coalesce(F.col(correct), F.lit(False))
    return samples.rollup(task).agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"), F.count_if(diagnosed).alias("with_diagnosis"))


def write_json(df: DataFrame, path: str, *, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, in one folder per value of `by` if given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_parquet(df: DataFrame, path: str, *, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def dump_rollouts(rollouts: DataFrame, path: str, *, step: str) -> None:
    """One folder of JSON lines per global step, with every column."""
    write_json(rollouts.withColumn("_step", F.col(step)), path, by=["_step"], mode="append")


def append_metrics(metrics: DataFrame, path: str, *, step: str, name: str, value: str) -> None:
    """One {step, data} line per step, behind earlier ones."""
    rows = metrics.groupBy(step).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("data"))
    write_json(rows, path, mode="append")


def append_records(samples: DataFrame, path: str, *, key: str, evaluate) -> DataFrame:
    """Evaluates the samples that the result files lack, appends them and returns all records."""
    spark = samples.sparkSession
    try:
        done = spark.read.json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        done = None
    todo = samples if done is None else samples.join(done.select(F.col(key).cast(samples.schema[key].dataType)).distinct(), key, "left_anti")
    write_json(evaluate(todo), path, mode="append")
    return spark.read.json(path)


def response_arrays(responses: DataFrame, *, prompt: str, order: str, text: str) -> DataFrame:
    """`responses`: the texts of a prompt's rows, in order."""
    rows = responses.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(text).alias("_t")))).alias("_r"))
    return rows.select(prompt, F.transform("_r", lambda r: r["_t"]).alias("responses"))
