"""Steps recorded from logits as they come, against the expressions over whole arrays; answer spans through decoders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veracity.functions import steps
from veracity.operators import recorder, spans

SCHEMA = "seq_id string, step int, logits array<float>, input_token int, final_token int"


@pytest.fixture(params=[2, 10_000])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("cells", [8, 1 << 21])
def test_steps(spark, batches, monkeypatch, cells):
    monkeypatch.setattr(recorder, "CELLS", cells)
    rnd = random.Random(1)
    rows, drawn = [], {}
    for s in range(12):
        n, vocabulary = rnd.randint(1, 9), rnd.choice([1, 4, 7])
        tokens = [rnd.randrange(vocabulary) for _ in range(n)]
        drawn[f"s{s}"] = tokens
        rows += [(f"s{s}", i, [rnd.gauss(0, 3) for _ in range(vocabulary)], None if i == 0 else tokens[i - 1], tokens[i] if i == n - 1 else None) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["seq_id"], r["step"]): r for r in recorder.record_steps(df).collect()}
    full = spark.createDataFrame([(*r, drawn[r[0]][r[1]]) for r in rows], SCHEMA + ", chosen int")
    want = full.withColumn("s", steps.step_statistics(F.col("logits"))).withColumn("log", steps.chosen_log_probability(F.col("logits"), F.col("chosen"))).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["seq_id"], r["step"]]
        assert [g["entropy"], g["max_probability"], g["margin"], g["chosen_log_probability"]] == pytest.approx([r["s"]["entropy"], r["s"]["max_probability"], r["s"]["margin"], r["log"]], abs=1e-12)
        assert g["token"] == drawn[r["seq_id"]][r["step"]]
    trimmed = recorder.record_steps(df, ends=[2]).groupBy("seq_id").count().collect()
    assert {r["seq_id"]: r["count"] for r in trimmed} == {k: v.index(2) + 1 if 2 in v else len(v) for k, v in drawn.items()}


def test_defined_cases(spark, batches):
    inf = float("-inf")
    rows = [
        ("last unknown", 0, [0.0, 1.0], None, None), ("last unknown", 1, [0.0, 1.0], 1, None), ("outside", 0, [0.0, 0.0], None, None), ("outside", 1, [0.0], 7, 0), ("prompt between", 0, [1.0, 0.0], None, None),
        ("prompt between", 1, [1.0, 0.0], None, None), ("prompt between", 2, [1.0, 0.0], 0, None), ("impossible", 0, [inf, 0.0], None, 0), (None, 0, [2.0], None, 0), ("empty", 0, [], None, 0), ("nothing", 0, None, None, 0),
    ]
    got = {(r["seq_id"], r["step"]): (r["token"], r["chosen_log_probability"]) for r in recorder.record_steps(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = math.log(1 / (1 + math.e))
    assert got.pop(("last unknown", 0)) == (1, pytest.approx(one + 1)) and got.pop(("prompt between", 1)) == (0, pytest.approx(one + 1))
    assert got == {("outside", 0): (7, None), ("outside", 1): (0, 0.0), ("impossible", 0): (0, None), (None, 0): (0, 0.0), ("empty", 0): (0, None), ("nothing", 0): (0, None)}
    assert recorder.record_steps(spark.createDataFrame([], SCHEMA)).count() == 0


def by_character(generations):
    return ["".join(map(chr, ids)) for ids in generations]


#: text, what the span holds
CASES = [
    ("The answer is seven.", None), ("Tom has 7 apples. #### 7", " 7"), ("#### Step 1\nAdd them.\n#### Step 2\nCheck.\n#### 7", " 7"), ("#### Summary\nAll done.", None), ("#### 1 first pass\nrevised\n#### 42", " 42"),
    ("#### 42\n#### Notes", " 42\n#### Notes"), ("blah #### 3", " 3"), ("", None), ("##### 5", None), ("########5", None), ("#### ####5", "5"), ("####²", "²"), ("#### 1 ##### 2", None),
]


@pytest.mark.parametrize("rising", [True, False])
def test_spans(rising):
    found = spans.answer_spans([[ord(c) for c in t] for t, _ in CASES], by_character, "####", rising)
    assert [t[s[0] : s[1]] if s else None for (t, _), s in zip(CASES, found, strict=True)] == [w for _, w in CASES]


def first_prefix(ids, decode, marker):
    """The first prefix, by trying all."""
    k = spans.markers_needed(decode([ids])[0], marker)
    return next(((m, len(ids)) for m in range(1, len(ids) + 1) if k and decode([ids[:m]])[0].count(marker) >= k), None)


def test_decoder_that_merges_bytes():
    """Tokens are bytes of UTF-8 or of the marker: the text of a prefix isn't a prefix of the text."""
    decode = lambda some: [b"".join(bytes([i]) if i < 256 else b"##" for i in ids).decode(errors="replace") for ids in some]
    rnd, calls = random.Random(4), []

    def counted(some):
        calls.append(len(some))
        return decode(some)

    made = [[*rnd.choices([256, 35, *"é 7x\n".encode()], k=rnd.randint(0, 60))] for _ in range(300)]
    want = [first_prefix(ids, decode, "####") for ids in made]
    assert spans.answer_spans(made, counted, "####") == want and len(calls) <= 8 and any(want)
    assert spans.answer_spans(made, decode, "####", rising=False) == want


def test_falling_counts():
    """A decoder whose later tokens take markers back needs the whole scan."""
    decode = lambda some: ["".join(chr(i) for i in ids).replace("!", "#") if len(ids) % 2 else "".join(chr(i) for i in ids) for ids in some]
    ids = [ord(c) for c in "a!!!! 5 #### 6"]
    assert spans.answer_spans([ids], decode, "####", rising=False) == [first_prefix(ids, decode, "####")]


def test_rows(spark, batches):
    df = spark.createDataFrame([(i, [ord(c) for c in t] if t else None, "x") for i, (t, _) in enumerate(CASES)], "id int, token_ids array<int>, answer_span string")
    got = {r["id"]: r["answer_span"] for r in spans.with_answer_span(df, lambda g: ["".join(map(chr, ids)) for ids in g]).collect()}
    assert {i: CASES[i][0][s["start"] : s["end"]] if s else None for i, s in got.items()} == {i: w for i, (_, w) in enumerate(CASES)}
    assert spans.with_answer_span(df.limit(0), lambda g: []).count() == 0
