"""Texts and ids that ended queries before: very long address parts, items without an id beside others, repeated ids in fits."""

import pytest

from veracity.llm import decontaminate, pii, quality, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_address_parts(spark):
    texts = ["1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "4", "1.2.3." + "9" * 5000, "1.2.3.4", "000.00.0.0256"]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    field = pii.train(df)
    assert {r["doc_id"]: r["n_ip"] for r in pii.find(df, field).collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0}
    assert pii.describe(texts[0], pii.tokens(texts[0]))[0].shape[0] == 1 and pii.redact(df, field).count() == 5


@pytest.mark.parametrize("block", [10**6, 40])
def test_items_without_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    passage, other = "the quick brown fox jumps over the lazy dog again", "seven wizards boxed five dozen liquor jugs today"
    bench = spark.createDataFrame([(4, passage), (None, passage), (None, other), (2, other), (None, "short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage} y {other}", "en", "a", 1), (2, "short", "en", "a", 1), (3, "clean words only", "en", "a", 1)], SCHEMA)
    assert {r["doc_id"]: r["items"] for r in decontaminate.find(docs, bench).collect()} == {1: [2, 4, None], 2: [None], 3: []}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [3]


def test_fits_are_bounded_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"some words {i} " * 5, "en", "a", 1) for i in range(600)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)] * 4, "doc_id long, quality int, toxic int")
    taken = []
    for module in (rules, quality):
        real = module.fit
        monkeypatch.setattr(module, "fit", lambda x, good, real=real: taken.append(len(x)) or real(x, good))
        module.train(docs, labels)
        module.train(docs, labels, rows=2)
    assert taken == [3, 2, 3, 2]
