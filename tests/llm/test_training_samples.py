"""Rows without an id and shared ids in the training samples, and the samples' bounds."""

import pytest

from veracity.llm import language, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pii_training_without_ids(spark):
    rows = [(None, "call +1 (212) 555-0142 now", "en", "a", 1), (1, "mail a@b.org 4111111111111111", "en", "a", 1), (None, "room 12", "en", "a", 1), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    field = pii.train(df)
    assert pii.find(df, field).count() == 4 and pii.redact(df, field).count() == 4


@pytest.mark.parametrize("shared", [None, 3])
def test_pii_sample_is_bounded(spark, monkeypatch, shared):
    """Rows that share an id, or have none, are sampled one by one."""
    taken = []
    monkeypatch.setattr(pii.Field, "fit", lambda texts: taken.append(texts))
    pii.train(spark.createDataFrame([(shared if i % 3 else i, f"room {i}", "en", "a", 1) for i in range(900)], SCHEMA), rows=60)
    assert 30 <= len(taken[0]) <= 60
    assert any(int(t[5:]) % 3 for t in taken[0]) and any(not int(t[5:]) % 3 for t in taken[0])
    pii.train(spark.createDataFrame([(shared, "room 1", "en", "a", 1)] * 500, SCHEMA), rows=60)
    assert len(taken[1]) <= 60


def test_language_sample_of_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 40)
    df = spark.createDataFrame([(5, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "a", 1) for i in range(600)], SCHEMA)
    [(name, content)] = language.dictionaries(df)
    assert name == "en" and 15 <= len(content.split()) <= 40
