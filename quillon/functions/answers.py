"""Answers out of free text, as column expressions for scoring jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:\.\d+)?)"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda x: x.cast("double"))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def choice_key(text: Column, options: Column) -> Column:
    """Letters that are valid for the number of options, each once and in order, joined by commas; else
    the letter of the option whose text it is; else the text, case folded."""
    clean = squeeze(text)
    letters = F.array_distinct(F.filter(F.regexp_extract_all(F.upper(clean), F.lit(r"\b([A-Z])\b"), 1), lambda x: F.ascii(x) - 65 < F.size(options)))
    bare = F.transform(options, lambda o: casefold(squeeze(F.regexp_replace(o, r"^\s*[A-Za-z][.):]\s*", ""))))
    place = F.array_position(bare, casefold(clean))
    return F.when(F.size(letters) > 0, F.array_join(letters, ",")).when(place > 0, F.char(place + 64)).otherwise(casefold(clean))


def sequence_key(text: Column) -> Column:
    """All runs of digits, joined by arrows."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), "->")


def interval(text: Column, mode: str = "last") -> Column:
    """struct(start, end) from the last or the first two numbers, or from [a, b] after </think>; null
    unless 0 <= start < end."""
    if mode == "bracket":
        tail = F.element_at(F.split(text, "</think>"), -1)
        found = F.array(*[F.regexp_extract(tail, r"\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]", k).try_cast("double") for k in (1, 2)])
        two = F.when(found[0].isNotNull(), found)
    elif mode in ("last", "first"):
        all_ = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
        two = F.when(F.size(all_) >= 2, F.slice(all_, -2 if mode == "last" else 1, 2))
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.when((two[0] >= 0) & (two[0] < two[1]), F.struct(two[0].alias("start"), two[1].alias("end")))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column, *, min_length: float = 0.0, zero: float = 0.0) -> Column:
    """Overlap over hull. Intervals shorter than min_length are widened about their centre; a hull of
    length zero gives `zero`."""
    def widen(s: Column, e: Column) -> tuple[Column, Column]:
        if not min_length:
            return s, e
        short = (e - s) < min_length
        low = F.greatest((s + e) / 2 - min_length / 2, F.lit(0.0))
        return F.when(short, low).otherwise(s), F.when(short, low + min_length).otherwise(e)

    (a, b), (c, d) = widen(s1, e1), widen(s2, e2)
    hull = F.greatest(b, d) - F.least(a, c)
    return F.when(hull > 0, F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0)) / hull).otherwise(zero)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rubric_tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit("([a-z0-9]+)"), 1))


def point_coverage(text: Column, points: Column, *, recall: float = 0.3) -> Column:
    """Share of the points of whose distinct tokens at least `recall` are in the text; no point, no share: 0.
    For the same points and many texts use rubric_coverage, which takes the points apart once."""
    own = rubric_tokens(text)
    hit = F.filter(F.transform(points, rubric_tokens), lambda p: (F.size(p) > 0) & (F.size(F.array_intersect(p, own)) >= recall * F.size(p)))
    return F.when(F.size(points) > 0, F.size(hit) / F.size(points)).otherwise(0.0)


def rubric_coverage(answers: DataFrame, rubrics: DataFrame, *, rubric: str, text: str, point: str, out: str = "coverage", recall: float = 0.3) -> DataFrame:
    """Each answer with the coverage of its rubric's points; rubrics(rubric, point), one row a point. Tokens of
    points and of answers are worked out once; an answer whose rubric has no points covers 0."""
    names = spare(answers.columns, "_points", "_own")
    points = rubrics.groupBy(rubric).agg(F.collect_list(rubric_tokens(F.col(point))).alias(names[0]))
    joined = answers.withColumn(names[1], rubric_tokens(F.col(text))).join(points, rubric, "left")
    own, found = F.col(names[1]), F.col(names[0])
    hit = F.filter(found, lambda p: (F.size(p) > 0) & (F.size(F.array_intersect(p, own)) >= recall * F.size(p)))
    return joined.withColumn(out, F.when(F.size(found) > 0, F.size(hit) / F.size(found)).otherwise(0.0)).drop(*names)


def spare(taken: list[str], *names: str) -> list[str]:
    """Names for columns of our own beside those that are taken."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def hash_number(text: Column, mode: str = "strict") -> Column:
    """The number after #### or, in flexible mode, the last number, in the last 300 characters."""
    tail = F.right(text, F.lit(300))
    if mode == "strict":
        found = F.element_at(F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), 1), -1)
    elif mode == "flexible":
        found = F.element_at(F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), 1), lambda x: ~x.isin("", ".")), -1)
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.translate(found, ",$", "") if mode == "strict" else found


def last_number(text: Column, mode: str = "strict") -> Column:
    """hash_number, or null where there is none."""
    tail = F.right(text, F.lit(300))
    pattern = r"#### (-?[0-9.,]+)" if mode == "strict" else r"(-?[0-9.,]+)"
    none = F.size(F.filter(F.regexp_extract_all(tail, F.lit(pattern), 1), lambda x: ~x.isin("", "."))) == 0
    return F.when(none, F.lit(None)).otherwise(hash_number(text, mode))


def qa_normal(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and repeated spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(plain, r"\b(a|an|the)\b", " "))


def tagged_answer(text: Column, tag: str = "answer") -> Column:
    """What the last <answer>…</answer> holds, trimmed; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def qa_match(answer: Column, golds: Column, *, part: bool = False) -> Column:
    """Whether the answer equals a gold answer after normalisation or, with part, holds one."""
    a = qa_normal(answer)
    return F.exists(golds, lambda g: a.contains(qa_normal(g)) if part else a == qa_normal(g))


def qa_score(text: Column, golds: Column, *, part: bool = False) -> Column:
    """1.0 for a matching tagged answer, a quarter of it if the text has more than 10 such tags."""
    answer = tagged_answer(text)
    tags = F.regexp_count(text, F.lit("</answer>"))
    return F.when(answer.isNull(), 0.0).when(qa_match(answer, golds, part=part), F.when(tags > 10, 0.25).otherwise(1.0)).otherwise(0.0)


#: What stands for something else in a final answer, and what it may carry beside its value, in the order in
#: which it is taken out. Fixed values.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}",
    r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots"]


def maths_normal(text: Column) -> Column:
    """The value of a final answer: what follows the last equals sign, in plain words of the rules:
    spellings that mean the same become one, units and spacing commands go; of a text with maths between
    dollar signs the first such part is the answer; text, bold, overline and box commands give way to
    what they hold; fractions and roots without braces get them; a whole number loses its commas."""
    out = F.element_at(F.split(text, "="), -1)
    for old, new in [*SUBSTITUTIONS, *((x, "") for x in REMOVED)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r".*?\$(.*?)\$.*", "$1")
    for command in ("text", "textbf", "overline"):
        out = F.regexp_replace(out, r"\\%s\{(.*?)\}" % command, "$1")
    out = F.regexp_replace(out, r"\\boxed\{(.*)\}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return let(F.replace(out, F.lit("$"), F.lit("")), lambda x: F.when(bare(x).rlike(r"^\d+$"), bare(x)).otherwise(F.trim(x)))


def answer_line(text: Column) -> Column:
    """What follows the last 'Answer:' on its line, cleaned up; [INVALID] if there is none."""
    found = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
    return F.when(F.size(found) > 0, maths_normal(F.element_at(found, -1))).otherwise("[INVALID]")


def answer_line_score(text: Column, truth: Column) -> Column:
    """struct(score of 1 or -1, acc, pred)."""
    def score(pred: Column) -> Column:
        ok = pred == maths_normal(truth)
        return F.struct(F.when(ok, 1.0).otherwise(-1.0).alias("score"), ok.alias("acc"), pred.alias("pred"))

    return let(answer_line(text), score)


def overlong_penalty(length: Column, *, limit: int, buffer: int, factor: float) -> Column:
    """0 up to limit - buffer, then falling by factor per buffer."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def letters_in(text: Column, valid: str = "ABCDEFGH") -> Column:
    """Distinct valid letters that stand alone in a text, in order; a JSON list's if the text is one."""
    listed = F.from_json(text, "array<string>")
    plain = F.regexp_extract_all(F.upper(text), F.lit(rf"\b([{valid}])\b"), 1)
    return F.array_distinct(F.coalesce(F.filter(F.transform(listed, lambda x: F.upper(F.trim(x))), lambda x: x.rlike(f"^[{valid}]$")), plain))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def answer_field(text: Column) -> Column:
    """The answer of a JSON object, else what follows 'answer:', else the text."""
    field = F.coalesce(*[F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), f"$.{k}") for k in ("final_answer", "answer")])
    line = F.regexp_extract(text, r"(?i)answer\s*:\s*([^\n]+)", 1)
    return F.trim(F.coalesce(field, F.when(line != "", line), text))


def json_in(text: Column) -> Column:
    """The JSON object of a text: the text itself, a fenced block's, or from its first brace to its last; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = [F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), F.trim(x)) for x in (text, fenced, braces)]
    return F.coalesce(*parsed)


def confidence(text: Column) -> Column:
    """The largest confidence from 1 to 10 that a text states; numbers up to 1 count tenfold."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)confidence[\"']?\s*[:=]?\s*(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.array_max(F.filter(F.transform(found, lambda x: F.when(x <= 1, x * 10).otherwise(x)), lambda x: x.between(1, 10)))


def span(text: Column) -> Column:
    """struct(start, end): of two numbers, or one number as a point; null without a number."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.when(F.size(n) >= 2, F.struct(n[0].alias("start"), n[1].alias("end"))).when(F.size(n) == 1, F.struct(n[0].alias("start"), n[0].alias("end")))


def named_id(text: Column, ids: Column, pattern: str) -> Column:
    """The one valid id that a text names; null for none or several."""
    hits = F.array_intersect(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), ids)
    return F.when(F.size(hits) == 1, hits[0])


def fill_placeholders(text: Column, objects: Column) -> Column:
    """{A1}, {A2}, … replaced by obj_<id> of the first, second, … object."""
    return F.aggregate(F.sequence(F.lit(1), F.size(objects)), text, lambda acc, k: F.replace(acc, F.concat(F.lit("{A"), k.cast("string"), F.lit("}")), F.concat(F.lit("obj_"), F.element_at(objects, k).cast("string"))))


def render_interval(start: Column, end: Column) -> Column:
    return F.format_string("[%.1f, %.1f]", start, end)


# ---- cleaning ----------------------------------------------------------------------


def strip_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def hide_frames(text: Column) -> Column:
    """Long texts without a space at their start, as encoded pictures are, become a mark."""
    return F.when((F.length(text) > 1000) & ~F.left(text, F.lit(100)).contains(" "), F.lit("<frame>")).otherwise(text)


def redact_data_uris(text: Column) -> Column:
    return F.regexp_replace(text, r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+", "<data-uri>")


def concise_answer(text: Column, *, sentences: int = 5, limit: int = 900) -> Column:
    """struct(text, review): the first sentences, cut at a word within the limit; empty texts give the
    UNCERTAIN text and no review, all others are for review."""
    clean = squeeze(text)
    first = F.array_join(F.slice(F.split(clean, r"(?<=[.!?])\s+"), 1, sentences), " ")
    cut = F.when(F.length(first) > limit, F.regexp_replace(F.left(first, F.lit(limit)), r"\s+\S*$", "")).otherwise(first)
    empty = F.coalesce(clean, F.lit("")) == ""
    return F.struct(F.when(empty, "UNCERTAIN: no answer was given.").otherwise(cut).alias("text"), (~empty).alias("review"))


def content_signature(df_columns: list[str], volatile: list[str]) -> Column:
    """sha256 of a row as JSON with its columns in order, volatile ones masked."""
    cols = [(F.lit("*") if c in volatile else F.col(f"`{c}`")).alias(c) for c in sorted(df_columns)]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


#: Colours, kinds of things and phrases of relations with their names, of counting questions. Fixed values.
COLOURS = ["light blue", "blue-green", "yellow", "red", "blue", "black", "white", "green", "grey", "cyan"]
KINDS = ["cycles", "sedans", "cars", "buses", "trucks", "vehicles"]
RELATIONS = [
    ("passes by", "pass-by"), ("pass by", "pass-by"), (" pass ", "pass-by"), ("overtakes", "overtake"), ("overtake", "overtake"), ("ahead of", "same-direction-ahead"), (" behind ", "same-direction-behind"),
    ("parked by the roadside", "parked"), ("parked in front of", "parked-front"), ("parked", "parked"), ("completely leaves", "leave-view"), ("leaves view", "leave-view"), ("level with", "level-with"),
    ("appear", "appear"), ("currently driving", "driving"), ("driving in", "driving"), ("show clear displacement", "moving")]
#: What ends the words for the counted things, and endings that do not belong to them. Fixed values.
STOPS = [
    "does ", "are ", "is ", "pass ", "overtake ", "parked ", "in ", "appear ", "leave ", "drive ", "currently ", "at ", "do you see ", "have ", "turn ", "show ", "completely ", "fully ", "oncoming ",
    "traveling ", "moving ", r"\?"]
TAILS = [" in total", " do you see", " have completely", " completely", " traveling", " moving", " on the same side"]


def count_clause(question: Column) -> Column:
    """What a counting question asks for: struct(category, colour, relation, reference, mentioned).

    Only the clause from "how many" on counts, whatever comes before it. The category is the first
    known colour and kind of thing in the words that follow, or all these words; the relation is the
    one whose phrase first occurs last, of phrases at one place the one listed first, else "?"; the
    reference is the {A1}-like alias that a relation is about, else the first one; mentioned are all
    aliases as first seen."""
    alias = r"\{([AB]\d)\}"
    looks = [r"(?i)\b(?:pass(?:es)?|pass\s+by|overtakes?)\s+" + alias, r"(?i)\b(?:ahead\s+of|behind)\s+" + alias, r"(?i)\bdoes\s+" + alias + r"\s+(?:pass(?:es)?|pass\s+by|overtakes?)", alias]

    def named(words: Column) -> Column:
        colour, kind = (F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(words, n)), F.lit(1)) for names in (COLOURS, KINDS))
        return F.struct(F.when(kind.isNotNull(), F.concat_ws(" ", colour, kind)).when(words != "", words).otherwise("the target category in the question").alias("category"), colour.alias("colour"))

    def asked(clause: Column) -> Column:
        low = F.lower(clause)
        words = F.trim(F.regexp_extract(low, "how many (.+?)(?: (?:" + "|".join(STOPS) + ")|$)", 1))
        for tail in TAILS:
            words = F.regexp_replace(words, rf"\s*{tail}$", "")
        there = F.filter(F.array(*[F.struct(F.instr(low, phrase).alias("at"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (phrase, name) in enumerate(RELATIONS)]), lambda r: r["at"] > 0)
        found = F.filter(F.array(*[F.regexp_extract(clause, look, 1) for look in looks]), lambda x: x != "")
        return F.struct(
            let(words, named).alias("what"), F.coalesce(F.array_max(there)["name"], F.lit("?")).alias("relation"), F.try_element_at(found, F.lit(1)).alias("reference"),
            F.array_distinct(F.regexp_extract_all(clause, F.lit(alias), 1)).alias("mentioned"))

    # the clause from "how many" on; a text without one is taken whole
    clause = F.regexp_replace(question, r"(?is)^.*?(?=\bhow\s+many\b)", "")
    return let(let(clause, asked), lambda c: F.struct(c["what"]["category"].alias("category"), c["what"]["colour"].alias("colour"), c["relation"].alias("relation"), c["reference"].alias("reference"), c["mentioned"].alias("mentioned")))
