"""White space and digits beyond ASCII, against Python's own strings and patterns."""

import random
import re
import string
import sys

import pytest
from pyspark.sql import functions as F

from veracity.functions import steps, text

SPACES = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
DIGITS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdecimal()]
_NUMBER = re.compile(r"-?\d[\d,]*(?:\.\d+)?")


def normal(t):
    return " ".join(w for w in t.lower().translate(str.maketrans("", "", string.punctuation)).split() if w not in ("a", "an", "the"))


def short(t):
    line = re.sub(r"^\s*(the\s+answer\s+is|answer\s*:|a\s*:)\s*", "", t.strip().split("\n")[0], flags=re.IGNORECASE)
    return line.strip().rstrip(".").strip()


def number(t):
    every = _NUMBER.findall(t)
    marked = _NUMBER.findall(t.rpartition("####")[2]) if "####" in t else []
    return float((marked or every[-1:])[0].replace(",", "")) if marked or every else None


def texts():
    rnd = random.Random(6)
    some = lambda: rnd.choice(SPACES)
    out = ["the cat", " Paris ", "٣٤", "x​y", "#### १२,३.४", "conf ９５%", "\u0085a\u001cb", "¼ ² 7"]
    out += [f"{some()}The{some()}answer{some()}is{some()}{rnd.choice(['Paris.', 'the  Cat…', '42'])}{some()}" for _ in range(60)]
    out += [f"a{some()}an{some()}dog{some()}!" for _ in range(30)] + ["".join(rnd.choice(["#", "####", some(), rnd.choice(DIGITS), rnd.choice(DIGITS), "1", ",", ".", "-", "x"]) for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    return out


def test_against_python(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    c = F.col("t")
    reply = re.compile(r"\d{1,3}")
    for r in df.select("i", text.normalize_answer(c).alias("n"), text.extract_short_answer(c).alias("s"), text.extract_final_number(c).alias("f"), text.snippet(c).alias("p"), text.verbalized_confidence(c).alias("v")).collect():
        t = given[r["i"]]
        assert r["n"] == normal(t) and r["s"] == short(t) and r["p"] == " ".join(t.split()), ascii(t)
        assert r["f"] == (pytest.approx(number(t)) if number(t) is not None else None), ascii(t)
        said = reply.search(t)
        assert r["v"] == (int(said.group()) / 100 if said and int(said.group()) <= 100 else None), ascii(t)


def test_every_space_and_digit(spark):
    df = spark.createDataFrame([(c,) for c in SPACES], "c string")
    assert df.where(text.normalize_answer(F.concat(F.lit("x"), "c", F.lit("y"))) != "x y").count() == 0
    df = spark.createDataFrame([(c, float(c)) for c in DIGITS], "c string, v double")
    assert df.where(text.extract_final_number(F.col("c")) != F.col("v")).count() == 0
    wide = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit()]
    df = spark.createDataFrame([(c,) for c in wide], "c string")
    assert df.where(steps.answer_span(F.split(F.concat(F.lit("#### "), "c"), "")).isNull()).count() == 0
    df = spark.createDataFrame([("½",), ("Ⅷ",), ("x",)], "c string")
    assert df.where(steps.answer_span(F.split(F.concat(F.lit("#### "), "c"), "")).isNotNull()).count() == 0
