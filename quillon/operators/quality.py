"""Validation, cleaning and shaping of task rows and turns: rows pass or go to quarantine with reasons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIAGNOSIS = "[DIAGNOSIS]"


# ---- validators: a message or null ---------------------------------------------------


def required_string(c: str) -> Column:
    return F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c}: empty"))


def string_list(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.exists(c, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), F.lit(f"{c}: not a list of strings"))


def number_list(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x)), F.lit(f"{c}: not a list of numbers"))


def ordered_interval(start: str, end: str) -> Column:
    ok = F.coalesce((F.col(start) >= 0) & (F.col(start) < F.col(end)), F.lit(False))
    return F.when(~ok, F.lit(f"{start}, {end}: not an interval"))


def equal_lengths(a: str, b: str) -> Column:
    return F.when(~F.coalesce(F.size(a) == F.size(b), F.lit(False)), F.lit(f"{a}, {b}: lengths differ"))


def distinct_items(c: str) -> Column:
    return F.when(F.size(F.array_distinct(c)) != F.size(c), F.lit(f"{c}: repeated"))


def check(df: DataFrame, *rules: Column) -> DataFrame:
    """`errors`: the messages of all rules that a row breaks."""
    return df.withColumn("errors", F.filter(F.array(*rules), lambda x: x.isNotNull()))


def passed(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def strict(checked: DataFrame) -> DataFrame:
    """The rows, or an error at the first that broke a rule."""
    return checked.filter(F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", "; "))).otherwise(True)).drop("errors")


# ---- canonical samples ---------------------------------------------------------------

#: Task codes by the shape of their raw rows.
CHOICE_TASKS = ["CC", "NC"]


def canonical_samples(raw: DataFrame) -> DataFrame:
    """Raw rows of the nine task codes to sample_id, task, video_paths, question, options, answer,
    intervals and errors. `raw` has the nullable columns task, id, question, videos, options, answer,
    video_a, video_b, begin, end, ref_segment, segments, vid."""
    task = F.col("task")
    two = F.array(F.col("video_a"), F.col("video_b"))
    pair = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    clips = F.zip_with("begin", "end", pair)
    paths = (F.when(task.isin("CCQA", "FSA"), two).when(task.isin("PSS", "PI"), F.transform(F.sequence(F.lit(1), F.when(task == "PSS", F.size("segments")).otherwise(F.lit(2))), lambda k: F.concat(F.col("video_a"), F.lit("#"), k.cast("string"))))
             .when(task.isin("MOC", "MSR"), F.array(*[F.concat(F.lit(f"{v}/"), F.col("vid").cast("string")) for v in ("view1", "view2")])).otherwise(F.col("videos")))
    spans = F.when(task == "PEA", clips).when(task == "PI", F.array(pair(F.col("begin")[0], F.col("begin")[1]), pair(F.col("end")[0], F.col("end")[1]))).when(task == "FSA", F.array(pair(F.col("ref_segment")[0], F.col("ref_segment")[1]))).when(task == "PSS", F.transform("segments", lambda s: pair(s[0], s[1])))
    out = raw.select(F.concat(task, F.lit("-"), F.col("id").cast("string")).alias("sample_id"), "task", paths.alias("video_paths"), "question", F.coalesce("options", F.array().cast("array<string>")).alias("options"), "answer", spans.alias("intervals"))
    known = ["CC", "NC", "CCQA", "FSA", "PEA", "PI", "PSS", "MOC", "MSR"]
    needs = F.when(F.col("task").isin("CC", "NC", "PEA", "PI", "MOC", "MSR") & (F.size("options") < 2), F.lit("options: fewer than two"))
    few = F.when(~F.coalesce(F.size("video_paths") >= 2, F.lit(False)), F.lit("video_paths: fewer than two"))
    bad = F.when(F.exists("intervals", lambda x: ~F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]), F.lit(False))), F.lit("intervals: not ordered"))
    uneven = F.when((F.col("task") == "PEA") & (F.size("intervals") != F.size("video_paths")), F.lit("begin, end: lengths differ"))
    return check(out, F.when(~F.col("task").isin(known), F.concat(F.lit("task: unknown "), "task")), required_string("answer"), F.when(~F.col("task").isin("FSA", "PSS"), required_string("question")), needs, few, distinct_items("video_paths"), bad, uneven)


def inference_payload(samples: DataFrame) -> DataFrame:
    """What may go to a model: no answer, no metadata."""
    return samples.drop("answer", "task_metadata", "ground_truth")


# ---- columns and rows ------------------------------------------------------------------


def select_keys(df: DataFrame, keys: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The named columns, some under new names; one that is missing raises."""
    missing = set(keys) - set(df.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    return df.select(*keys).withColumnsRenamed(rename or {})


def pop_keys(df: DataFrame, keys: list[str], *, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the popped columns with the row key, the rest)."""
    return df.select(*keep, *keys), df.drop(*keys)


def select_rows(df: DataFrame, *, index: str, ids: DataFrame | None = None, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows whose index is listed, or in start, start + step, … below stop."""
    if ids is not None:
        return df.join(ids.select(F.col(ids.columns[0]).alias(index)).distinct(), index, "left_semi")
    i = F.col(index)
    inside = i >= (start or 0)
    if stop is not None:
        inside = inside & (i < stop)
    return df.filter(inside & (F.pmod(i - (start or 0), F.lit(step)) == 0))


def filter_long(df: DataFrame, *, length: Column, limit: int) -> DataFrame:
    """Rows of at most `limit`; a length that cannot be told counts as too long."""
    return df.filter(F.coalesce(length, F.lit(limit + 1)) <= limit)


def fit_ids(df: DataFrame, *, ids: str, limit: int, mode: str = "right", pad: Column | None = None, prompt_length: str | None = None) -> DataFrame:
    """ids cut on the right or left, or an error, then padded to the limit; attention_mask and, with a
    prompt length, loss_mask, which leaves out the prompt and the last token."""
    n = F.size(ids)
    cut = {"right": F.slice(ids, 1, limit), "left": F.when(n > limit, F.slice(ids, -limit, limit)).otherwise(F.col(ids)), "error": F.when(n > limit, F.raise_error(F.lit("longer than the limit"))).otherwise(F.col(ids))}
    if mode not in cut:
        raise ValueError(f"unknown mode {mode}")
    out = df.withColumn(ids, cut[mode]).withColumn("_n", F.size(ids))
    fill = F.greatest(F.lit(limit) - F.col("_n"), F.lit(0))
    out = out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), fill)))
    if prompt_length:
        out = out.withColumn("loss_mask", F.transform(F.sequence(F.lit(1), F.lit(limit)), lambda k: ((k > F.col(prompt_length)) & (k < F.col("_n"))).cast("int")))
    if pad is not None:
        out = out.withColumn(ids, F.concat(ids, F.array_repeat(pad, fill)))
    return out.drop("_n")


def response_mask(ids: Column, stops: list[int]) -> Column:
    """1 up to and with the first stop token."""
    found = F.array_min(F.filter(F.transform(F.array(*map(F.lit, stops)), lambda x: F.array_position(ids, x)), lambda k: k > 0))
    kept = F.coalesce(found, F.size(ids).cast("long")).cast("int")
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.size(ids) - kept))


# ---- turns -------------------------------------------------------------------------------


def strip_corrections(turns: DataFrame, *, conv: str, turn: str, role: str, text: str, marker: str = DIAGNOSIS) -> DataFrame:
    """Without each user message that holds the marker and the run of assistant turns right before it."""
    after = Window.partitionBy(conv).orderBy(turn).rowsBetween(1, Window.unboundedFollowing)
    is_marker = (F.col(role) == "user") & F.col(text).contains(marker)
    next_other = F.first(F.when(F.col(role) != "assistant", F.coalesce(is_marker, F.lit(False))), ignorenulls=True).over(after)
    drop = F.coalesce(is_marker, F.lit(False)) | ((F.col(role) == "assistant") & F.coalesce(next_other, F.lit(False)))
    return turns.withColumn("_drop", drop).filter("not _drop").drop("_drop")


def to_training_message(role: Column, content: Column) -> Column:
    """struct(role, content): tool turns become user turns with a heading; null content is empty."""
    tool = role == "tool"
    text = F.coalesce(content, F.lit(""))
    return F.struct(F.when(tool, "user").otherwise(role).alias("role"), F.when(tool, F.concat(F.lit("[TOOL OBSERVATION]\n"), text)).otherwise(text).alias("content"))


def flatten_parts(parts: Column) -> Column:
    """The text parts of a message, joined by newlines."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def message_parts(text: Column) -> Column:
    """Typed parts of a text with <image> and <video> placeholders."""
    pieces = F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")))


def media_match(text: Column, images: Column, videos: Column) -> Column:
    return (F.regexp_count(text, F.lit("<image>")) == images) & (F.regexp_count(text, F.lit("<video>")) == videos)


def leaked_answers(docs: DataFrame, items: DataFrame, *, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int = 8) -> DataFrame:
    """(doc, item) pairs where the trimmed item text is in the document, in whatever marks.

    Of an item in a document all words but the first and the last are words of the document too: the
    first may hang on a quote, the last on a full stop. So items meet only documents that share a hash
    of their first n inner words; texts are fetched for those that met. Items of one or two words, which
    have no inner ones, make automata of a bounded size each, which run over every text once."""
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    hashed = lambda w, start, size: F.xxhash64(F.array_join(F.slice(w, start, size), " "))
    item = items.select(F.col(item_id), F.trim(item_text).alias("_item"), words(item_text).alias("_w")).filter("_item != ''")
    inner = F.least(F.size("_w") - 2, F.lit(n))
    long = item.filter(F.size("_w") > 2).select(item_id, "_item", inner.alias("_size"), hashed(F.col("_w"), 2, inner).alias("_key"))
    sizes = long.select("_size").distinct()  # at most n rows
    doc = docs.select(F.col(doc_id), words(doc_text).alias("_d")).crossJoin(F.broadcast(sizes)).filter(F.size("_d") >= F.col("_size"))
    keys = F.transform(F.sequence(F.lit(1), F.size("_d") - F.col("_size") + 1), lambda k: hashed(F.col("_d"), k, F.col("_size")))
    met = doc.select(doc_id, "_size", F.explode(F.array_distinct(keys)).alias("_key")).join(long, ["_size", "_key"]).select(doc_id, item_id, "_item").distinct()
    texts = docs.select(F.col(doc_id), F.col(doc_text).alias("_text"))
    hits = met.join(texts, doc_id).filter(F.contains("_text", "_item")).select(doc_id, item_id)
    short = item.filter(F.size("_w") <= 2).select(item_id, "_item")
    return hits.unionByName(containing(texts, short, doc_id=doc_id, text="_text", item_id=item_id, item="_item")).distinct()


#: Bytes of items, with 32 more each, that one automaton is made of.
AUTOMATON_BYTES = 8 << 20


def _found(handle, doc_id: str, item_id: str, kind: pa.DataType):
    """Which items each text holds, by an automaton of all of them that is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids, items = handle.value
        automaton = ahocorasick.Automaton()
        for k, x in enumerate(items):
            automaton.add_word(x, (*automaton.get(x, ()), k))
        automaton.make_automaton()
        for batch in batches:
            row, item = [], []
            for r, text in enumerate(batch.column("_text").to_pylist()):
                if text:
                    seen = {k for _, same in automaton.iter(text) for k in same}
                    row += [r] * len(seen)
                    item += seen
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(row, pa.int64())), pa.array([ids[k] for k in item], kind)], names=[doc_id, item_id])

    return run


def containing(texts: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item: str) -> DataFrame:
    """(doc, item) for each item that occurs in a text, whatever is around it. Items are dealt to automata of
    AUTOMATON_BYTES each; a text is read once for each automaton, and no pair is tried. Empty items occur nowhere."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = texts.sparkSession
    items = items.filter(F.length(item) > 0)
    size = items.agg(F.sum(F.octet_length(item) + 32)).first()[0] or 0
    shards = max(1, -(-int(size) // AUTOMATON_BYTES))
    kinds = {f.name: f.dataType for f in [*texts.schema.fields, *items.schema.fields]}
    schema = f"`{doc_id}` {kinds[doc_id].simpleString()}, `{item_id}` {kinds[item_id].simpleString()}"
    out = None
    for k in range(shards):
        some = items.filter(F.pmod(F.xxhash64(item), F.lit(shards)) == k).select(item_id, item).toArrow()  # about AUTOMATON_BYTES
        handle = spark.sparkContext.broadcast((some.column(item_id).to_pylist(), some.column(item).to_pylist()))
        part = texts.select(doc_id, F.col(text).alias("_text")).mapInArrow(_found(handle, doc_id, item_id, to_arrow_type(kinds[item_id])), schema)
        if some.num_rows:
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def answer_in_prompt(df: DataFrame, *, prompt: str, truth: str, out: str = "leaked") -> DataFrame:
    """Whether the trimmed ground truth is part of the prompt; an empty truth leaks nothing."""
    t = F.trim(truth)
    return df.withColumn(out, F.coalesce((t != "") & F.col(prompt).contains(t), F.lit(False)))


def mine_tool_questions(entries: DataFrame, *, targets: str, prompt: str) -> DataFrame:
    """Tool calls with a single target whose prompt is a closed question and no survey, with their kind."""
    p = F.lower(prompt)
    survey = p.rlike("survey|overview|describe (all|every)|scan the whole")
    kind = F.when(p.rlike(r"\bhow many\b|\bcount\b"), "count").when(p.rlike(r"\bwhen\b|\btime\b"), "time").when(p.rlike(r"^(is|are|does|do|did|was|were|has|have|can)\b"), "yes_no").when(p.rlike(r"\bwhich\b|\bwhat\b|\bwho\b|\bwhere\b"), "what")
    return entries.withColumn("prompt_kind", kind).filter((F.size(targets) == 1) & ~survey & kind.isNotNull())


# ---- answers of agents -------------------------------------------------------------------------


def duration_band(start: Column, end: Column, *, longest: float = 45.0, shortest: float = 6.0, eps: float = 1e-6) -> Column:
    d = end - start
    return F.when(d > longest + eps, "OVERLONG").when(d < shortest - eps, "UNDERSHORT").otherwise("NORMAL")


def order_check(df: DataFrame, *, answer: str, n: str, confidence: str | None = None, least: float = 8.0) -> DataFrame:
    """found, missing, repeated and out-of-range numbers of an answered order, ok and the first reason against it."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    every = F.sequence(F.lit(1), F.col(n).cast("int"))
    out = df.withColumn("found", found)
    out = out.withColumns({"missing": F.array_except(every, F.col("found")), "repeated": F.size("found") != F.size(F.array_distinct("found")), "out_of_range": F.size(F.array_except("found", every)) > 0})
    low = F.coalesce(F.col(confidence), F.lit(0.0)) < least if confidence else F.lit(False)
    issue = F.when(F.size("found") == 0, "no order").when(F.col("out_of_range"), "out of range").when(F.col("repeated"), "repeated").when(F.size("missing") > 0, "missing").when(low, "confidence too low")
    return out.withColumn("issue", issue).withColumn("ok", F.col("issue").isNull())


def interval_check(df: DataFrame, *, start: str, end: str, duration: str) -> DataFrame:
    """The interval with its ends in order, ok and the reason against it."""
    a, b = F.least(start, end), F.greatest(start, end)
    issue = F.when(a.isNull(), "no interval").when(a < 0, "negative").when(a == b, "empty").when(b > F.col(duration) + 1, "beyond the end")
    return df.withColumns({"issue": issue, start: a, end: b}).withColumn("ok", F.col("issue").isNull())


def state_errors(state: Column, ids: Column) -> Column:
    """All that is wrong with a reasoner state struct(alternatives, factors, ambiguities array<struct<videos>>, decision, answer)."""
    rules = [
        F.when(F.size(state["alternatives"]) > 2, "more than 2 alternatives"), F.when(F.size(state["factors"]) > 6, "more than 6 factors"), F.when(F.size(state["ambiguities"]) > 2, "more than 2 ambiguities"),
        F.when(F.size(F.array_except(F.flatten(F.transform(state["ambiguities"], lambda a: a["videos"])), ids)) > 0, "unknown video"), F.when(F.exists(state["ambiguities"], lambda a: F.size(a["videos"]) > 2), "more than a pair"),
        F.when((state["decision"] == "answer") & (F.size(state["ambiguities"]) > 0), "answered with ambiguities left"), F.when((state["decision"] == "observe") & (F.size(state["ambiguities"]) == 0), "nothing to observe"), F.when(state["answer"].isNull(), "no answer")]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def fill_order(order: Column, ids: Column) -> tuple[Column, Column]:
    """(known ids as first seen, then the missing ones; the missing ones)."""
    known = F.array_distinct(F.filter(order, lambda x: F.array_contains(ids, x)))
    added = F.array_except(ids, known)
    return F.concat(known, added), added


#: What makes a visual result inconclusive, what does so only beside no count, and what a count looks like. Fixed values.
STRONG = ["cannot determine", "cannot verify", "unable to determine", "unable to verify", "insufficient evidence", "witness: undetermined"]
WEAK = ["not visible"]
COUNTED = r"(?i)(?:witness\s+)?qualifying\s+(?:instances/events\s+in\s+this\s+view:\s*|count:\s*)\d+"


def gate_choice_flip(previous: Column, candidate: Column, evidence: Column) -> Column:
    """The previous answer if there is new evidence and all of it is inconclusive, else the candidate. A null
    answer is no answer, and nothing is held back for or against it."""
    holds = lambda e, words: F.lower(e).rlike("|".join(words))
    none = F.forall(evidence, lambda e: holds(e, STRONG) | (holds(e, WEAK) & ~e.rlike(COUNTED)))
    return F.when((previous != candidate) & (F.size(evidence) > 0) & none, previous).otherwise(candidate)


def preference_pairs(df: DataFrame, *, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows per row: the prompt with the chosen and with the rejected response."""
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.col(prompt), F.col(c)).alias("sequence")) for k, c in (("chosen", chosen), ("rejected", rejected))])
    return df.withColumn("_p", F.explode(both)).select(*[F.col(f"`{c}`") for c in df.columns if c not in (prompt, chosen, rejected)], "_p.*")
