"""Scorers by data source or task, user scorers, and scans that regular expressions cannot do."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import answers as an

Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def register_scorer(source: str):
    """A (text, truth) -> score expression for a data source."""
    def add(f: Scorer) -> Scorer:
        SCORERS[source] = f
        return f

    return add


register_scorer("number")(lambda text, truth: F.coalesce((an.last_number(text) == truth).cast("double"), F.lit(0.0)))
register_scorer("number-flexible")(lambda text, truth: F.coalesce((an.last_number(text, "flexible") == truth).cast("double"), F.lit(0.0)))
register_scorer("qa")(lambda text, truth: an.qa_score(text, F.array(truth)))
register_scorer("qa-part")(lambda text, truth: an.qa_score(text, F.array(truth), part=True))
register_scorer("answer-line")(lambda text, truth: an.answer_line_score(text, truth)["score"])
register_scorer("sequence")(lambda text, truth: ((an.sequence_key(text) == an.sequence_key(truth)) & (an.sequence_key(truth) != "")).cast("double"))
register_scorer("tool-answer")(lambda text, truth: tool_answer_score(text, truth))
register_scorer("boxed")(lambda text, truth: boxed_score(text, truth))


def dispatch(source: Column, text: Column, truth: Column, routes: dict[str, str]) -> Column:
    """The score by the scorer of each source; a source without a route raises when it is read."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, scorer in routes.items():
        if scorer not in SCORERS:
            raise ValueError(f"unknown scorer {scorer}; there are {', '.join(sorted(SCORERS))}")
        out = out.when(source == name, SCORERS[scorer](text, truth))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(source, F.lit("null")))))


def task_metric(task: Column, pred: Column, truth: Column, options: Column, *, tolerance: float | None = None) -> Column:
    """Score by task: choices by letter, orders by sequence, FSA by interval overlap (or 1 within
    `tolerance` on both ends), CCQA null because it needs a judge."""
    p, t = an.interval(pred), an.interval(truth)
    iou = F.coalesce(an.interval_iou(p["start"], p["end"], t["start"], t["end"]), F.lit(0.0))
    if tolerance is not None:
        iou = F.coalesce(((F.abs(p["start"] - t["start"]) <= tolerance) & (F.abs(p["end"] - t["end"]) <= tolerance)).cast("double"), F.lit(0.0))
    return (F.when(task == "PSS", (an.sequence_key(pred) == an.sequence_key(truth)).cast("double")).when(task == "FSA", iou).when(task == "CCQA", F.lit(None).cast("double"))
            .otherwise((an.choice_key(pred, options) == an.choice_key(truth, options)).cast("double")))


# ---- scans of balanced braces -------------------------------------------------------


def balanced_objects(text: str) -> list[tuple[int, int, dict]]:
    """Outermost JSON objects of a text, with their places; text in quotes does not count as braces."""
    out, at = [], 0
    decoder = json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            out.append((at, end, value))
            at = end
        except ValueError:
            at += 1
    return out


@F.pandas_udf(T.StringType())
def final_answer(texts: pd.Series) -> pd.Series:
    """The answer of the last object whose action is 'answer': params.final_answer, else final_answer."""
    def one(text: str | None) -> str | None:
        for _, _, x in reversed(balanced_objects(text or "")):
            if x.get("action") == "answer":
                params = x.get("params")
                value = params["final_answer"] if isinstance(params, dict) and "final_answer" in params else x.get("final_answer")
                return None if value is None else value if isinstance(value, str) else json.dumps(value)
        return None

    return texts.map(one)


def tool_answer_score(text: Column, truth: Column) -> Column:
    return F.coalesce((F.upper(F.trim(final_answer(text))) == F.upper(F.trim(truth))).cast("double"), F.lit(0.0))


@F.pandas_udf(T.StringType())
def last_boxed(texts: pd.Series) -> pd.Series:
    """What the last \\boxed{…} or \\fbox{…} holds, braces balanced."""
    def one(text: str | None) -> str | None:
        text = text or ""
        at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
        if at < 0:
            return None
        start, depth = text.index("{", at), 0
        for k in range(start, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if not depth:
                return text[start + 1 : k]
        return None

    return texts.map(one)


def latex_key(x: Column) -> Column:
    """LaTeX of a value in one form: plain fractions and roots, no degree or percent signs, no units on the right, leading zeros."""
    out = F.split(x, r"\\text\{ ")[0]
    for a, b in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), ("%", ""), (" ", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"(^|[ {])\.", "$10.")
    out = F.regexp_replace(out, r"^[A-Za-z]{1,2}=", "")
    out = F.regexp_replace(out, r"\\sqrt([^{\[])", r"\\sqrt{$1}")
    out = F.regexp_replace(out, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    out = F.regexp_replace(out, r"\\frac([^{])\{", r"\\frac{$1}{")
    out = F.when(out == "0.5", "\\frac{1}{2}").otherwise(out)
    return F.regexp_replace(out, r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}")


def boxed_score(text: Column, truth: Column) -> Column:
    """1.0 if the last box holds the truth, compared as LaTeX keys."""
    return F.coalesce((latex_key(last_boxed(text)) == latex_key(truth)).cast("double"), F.lit(0.0))


CALL = T.StructType().add("name", T.StringType()).add("arguments", T.StringType())


@F.pandas_udf(T.StructType().add("rest", T.StringType()).add("calls", T.ArrayType(CALL)))
def tool_calls(texts: pd.Series, formats: pd.Series) -> pd.DataFrame:
    """The remaining text and its tool calls. Formats: hermes (<tool_call> blocks), channel (calls marked
    by channel, reasoning dropped) and object (balanced objects with an action). Bad JSON is skipped."""
    import re

    def tagged(text: str) -> tuple[str, list]:
        calls = []
        for block in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text):
            try:
                x = json.loads(block)
                calls.append((x["name"], json.dumps(x["arguments"], ensure_ascii=False)))
            except (ValueError, KeyError, TypeError):
                continue
        return re.sub(r"(?s)<tool_call>.*?</tool_call>", "", text), calls

    def channel(text: str) -> tuple[str, list]:
        text = re.sub(r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "", text)
        pattern = r"(?s)<\|channel\|>commentary to=functions\.([\w.-]+)[^<]*(?:<\|constrain\|>\w+)?<\|message\|>(.*?)<\|call\|>"
        return re.sub(pattern, "", text), [(n, a) for n, a in re.findall(pattern, text) if _is_json(a)]

    def objects(text: str) -> tuple[str, list]:
        calls, rest, at = [], [], 0
        for a, b, x in balanced_objects(text):
            if "action" in x:
                arguments = x.get("params", {k: v for k, v in x.items() if k not in ("action", "thought")})
                calls.append((x["action"], json.dumps(arguments, ensure_ascii=False)))
                rest.append(text[at:a])
                at = b
        return "".join([*rest, text[at:]]), calls

    how = {"hermes": tagged, "channel": channel, "object": objects}
    found = [how[f](t or "") for t, f in zip(texts, formats)]
    return pd.DataFrame({"rest": [r for r, _ in found], "calls": [[{"name": n, "arguments": a} for n, a in c] for _, c in found]})


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def extract_calls(df: DataFrame, *, text: str, format_: str) -> DataFrame:
    """One row per tool call of a text: position, name and arguments."""
    parsed = df.withColumn("_p", tool_calls(F.col(text), F.lit(format_)))
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c != text], F.posexplode("_p.calls").alias("position", "c")).select("*", "c.*").drop("c")


# ---- user scorers and presets ----------------------------------------------------------


def load_scorer(path: str, name: str, **bound) -> Callable[..., float | dict]:
    """A Python scorer (source, text, truth, extra) -> number or dict from a file, with bound arguments."""
    spec = importlib.util.spec_from_file_location("user_scorer", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    f = getattr(module, name)
    return lambda source, text, truth, extra: f(source, text, truth, extra, **bound)


def user_score(f: Callable[..., float | dict], *, failed: float | None = 0.0):
    """struct(score, extra) from a Python scorer, batch by batch; a call that fails scores `failed`, or raises if that is None."""
    @F.pandas_udf("score double, extra map<string,string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for source, text, truth, extra in batches:
            rows = []
            for args in zip(source, text, truth, extra):
                try:
                    got = f(*args)
                except Exception:
                    if failed is None:
                        raise
                    got = failed
                got = got if isinstance(got, dict) else {"score": got}
                rows.append((float(got["score"]), {k: str(v) for k, v in got.items() if k != "score"}))
            yield pd.DataFrame(rows, columns=["score", "extra"])

    return run


#: Rows, and bytes of their columns, that a scorer of lists gets at once.
SCORED_ROWS, SCORED_BYTES = 1024, 4 << 20


def batch_score(f: Callable[[list, list, list, list], list[float]]):
    """A scorer of lists, once per batch of at most SCORED_ROWS rows and, but for a single longer row, SCORED_BYTES: Python
    holds no more than that as objects, however many rows Spark sends at once."""
    @F.arrow_udf("double")
    def run(source: pa.Array, text: pa.Array, truth: pa.Array, extra: pa.Array) -> pa.Array:
        columns, out, at = (source, text, truth, extra), [], 0
        while at < len(text):
            n = min(SCORED_ROWS, len(text) - at)
            while n > 1 and sum(c.slice(at, n).nbytes for c in columns) > SCORED_BYTES:
                n = -(-n // 2)
            scores = np.asarray(f(*[c.slice(at, n).to_pylist() for c in columns]), dtype=np.float64)
            if len(scores) != n:
                raise ValueError(f"{len(scores)} scores for {n} rows")
            out.append(scores)
            at += n
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64(), from_pandas=True)

    return run


MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def register_manager(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in MANAGERS and MANAGERS[name] is not f:
            raise ValueError(f"{name} is registered already")
        MANAGERS[name] = f
        return f

    return add


def manager(name: str) -> Callable[..., DataFrame]:
    if name not in MANAGERS:
        raise ValueError(f"unknown reward manager {name}; there are {', '.join(sorted(MANAGERS))}")
    return MANAGERS[name]


@register_manager("naive")
def naive(df: DataFrame, *, score: Column) -> DataFrame:
    return df.withColumn("reward", score)


@register_manager("dapo")
def dapo(df: DataFrame, *, score: Column, length: str, limit: int, buffer: int, factor: float) -> DataFrame:
    """Score plus the penalty of overlong responses."""
    return df.withColumn("overlong", an.overlong_penalty(F.col(length), limit=limit, buffer=buffer, factor=factor)).withColumn("reward", score + F.col("overlong"))


@register_manager("prime")
def prime(df: DataFrame, *, score: Column) -> DataFrame:
    """A score that could not be made counts 0."""
    return df.withColumn("reward", F.coalesce(score, F.lit(0.0)))


@register_manager("batch")
def batch(df: DataFrame, *, score: Column) -> DataFrame:
    """`score` is a batch_score expression."""
    return df.withColumn("reward", score)


def reward_on_last_token(tokens: DataFrame, *, seq: str, pos: str, mask: str, reward: str) -> DataFrame:
    """The sequence's reward on its last masked token, 0 elsewhere."""
    last = F.max(F.when(F.col(mask), F.col(pos))).over(Window.partitionBy(seq))
    return tokens.withColumn("token_reward", F.when(F.col(pos) == last, F.col(reward)).otherwise(0.0))
