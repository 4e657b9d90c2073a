"""Answer texts as column expressions: normalisation, extraction, scoring, prompts."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be as given for equal results.
ARTICLES = ("a", "an", "the")
#: White space and digits are those of Unicode, not only of ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ANSWER_PREFIX = rf"^{SPACE}*(the{SPACE}+answer{SPACE}+is|answer{SPACE}*:|a{SPACE}*:){SPACE}*"
MARKER = "####"
TOLERANCE = 1e-4
TASKS = ("nq_open", "gsm8k")
SYSTEM_PROMPTS = {
    "nq_open": "You are a helpful assistant answering trivia questions. Reply with the short answer only -- a name, date, or phrase. Do not explain, and do not write a full sentence.",
    "gsm8k": "You are a careful mathematician. Solve the problem step by step, then state the final numeric answer on its own last line in the exact format '#### <number>'.",
}
CONFIDENCE_PROMPT = "How confident are you that the answer above is correct? Reply with a single integer from 0 to 100 and nothing else."

#: Decimal digits of all other scripts, and the ASCII digits of their values.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
#: Their class; three scripts are newer than the engine's tables.
_D = r"\p{Nd}\x{11f50}-\x{11f59}\x{16ac0}-\x{16ac9}\x{1e4f0}-\x{1e4f9}"
NUMBER = rf"-?[{_D}][{_D},]*(?:\.[{_D}]+)?"


def strip(c: Column) -> Column:
    """Without white space at the ends (trim() takes spaces only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, words joined by one space."""
    parts = F.split(F.regexp_replace(F.lower(c), r"\p{Punct}", ""), f"{SPACE}+")
    return F.array_join(F.filter(parts, lambda t: ~t.isin("", *ARTICLES)), " ")


def extract_short_answer(c: Column) -> Column:
    """The first line without a leading answer phrase and closing dots."""
    line = F.regexp_replace(F.element_at(F.split(strip(c), "\n"), 1), "(?iu)" + ANSWER_PREFIX, "")
    return strip(F.regexp_replace(strip(line), r"\.+$", ""))


def score_alias(generation: Column, aliases: Column) -> Column:
    """Whether the short answer equals an alias, both normalised, and isn't empty."""
    found = normalize_answer(extract_short_answer(generation))
    return F.coalesce((found != "") & F.exists(aliases, lambda a: normalize_answer(a) == found), F.lit(False))


def _ascii(number: Column) -> Column:
    """A number in ASCII digits; most are already, and the long table is for the others."""
    return F.when(number.rlike(r"^[\x00-\x7f]*$"), number).otherwise(F.translate(number, DIGITS, VALUES))


def parse_number(c: Column) -> Column:
    return _ascii(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def extract_final_number(c: Column) -> Column:
    """The first number after the last marker, else the last number of the text, else null."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1))
    marked = F.when(F.contains(c, F.lit(MARKER)), F.get(numbers(F.substring_index(c, MARKER, -1)), 0))
    every = numbers(c)
    return parse_number(F.coalesce(marked, F.get(every, F.size(every) - 1)))


def score_number(generation: Column, gold: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(extract_final_number(generation) - extract_final_number(gold)) <= tolerance, F.lit(False))


def format_number(v: Column) -> Column:
    """Whole numbers (within the tolerance) without a point, others with six significant digits."""
    general = F.format_string("%.6g", v)
    short = F.when(general.contains("."), F.regexp_replace(general, r"\.?0+(?=$|e)", "")).otherwise(general)
    return F.when(F.abs(v - F.bround(v)) <= TOLERANCE, F.bround(v).cast("decimal(38,0)").cast("string")).when(v.isNotNull(), short)


def _by_task(task: Column, alias: Column, number: Column) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null"))))
    return F.when(task == "nq_open", alias).when(task == "gsm8k", number).otherwise(unknown)


def score_generation(task: Column, generation: Column, golds: Column) -> Column:
    return _by_task(task, score_alias(generation, golds), score_number(generation, F.get(golds, 0)))


def canonical_answer(task: Column, generation: Column) -> Column:
    """The form in which answers are compared with each other; empty if there is none."""
    number = F.coalesce(format_number(extract_final_number(generation)), F.lit(""))
    return _by_task(task, normalize_answer(extract_short_answer(generation)), number)


def score_canonical(task: Column, answer: Column, golds: Column) -> Column:
    """The score of an answer that is canonical already."""
    again = F.when(task == "gsm8k", F.concat(F.lit(MARKER + " "), answer)).otherwise(answer)
    return F.when(answer == "", F.lit(False)).otherwise(score_generation(task, again, golds))


def verbalized_confidence(reply: Column) -> Column:
    """The first run of at most three digits as a share of 100; null if there is none or it is over 100."""
    v = _ascii(F.nullif(F.regexp_extract(reply, f"([{_D}]{{1,3}})", 1), F.lit(""))).try_cast("double")
    return F.when(v <= 100, v / 100)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(task: Column, question: Column) -> Column:
    system = F.coalesce(*[F.when(task == t, F.lit(p)) for t, p in SYSTEM_PROMPTS.items()], F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null")))))
    return F.array(_message("system", system), _message("user", question))


def confidence_messages(task: Column, question: Column, answer: Column) -> Column:
    return F.concat(chat_messages(task, question), F.array(_message("assistant", answer), _message("user", F.lit(CONFIDENCE_PROMPT))))


def render_prompt(messages: Column) -> Column:
    """Messages as one text that ends where the assistant speaks."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|assistant|>\n"))


def snippet(c: Column, length: int = 70) -> Column:
    """White space collapsed, cut to `length` characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)


def decimals(c: Column, places: int = 3) -> Column:
    """Fixed decimals; a dash for what isn't finite."""
    return F.when(finite(c), F.call_function("format_number", c, F.lit(f"0.{'0' * places}"))).otherwise("—")


def percent(c: Column, places: int = 0) -> Column:
    pattern = "0" + ("." + "0" * places if places else "")
    return F.when(finite(c), F.concat(F.call_function("format_number", c * 100, F.lit(pattern)), F.lit("%"))).otherwise("—")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
