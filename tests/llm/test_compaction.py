"""The query's own batches reach compaction, and the compacted run is read."""

from veracity.llm import substring

from .test_operators import SCHEMA, corpus, removed


def test_default_batches_compact(spark, monkeypatch):
    runs, add = [], substring.FingerprintIndex.add

    def noted(self, docs):
        runs.append(len(self.runs))
        return add(self, docs)

    monkeypatch.setattr(substring.FingerprintIndex, "add", noted)
    rows = corpus(7, 80)
    found = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = removed({i: (t or "").encode().split() for i, t, *_ in rows}, substring.WINDOW)
    assert found == {d: sum(g) for d, g in want.items()} and runs == [0, 1, 2, 3, 4, 1]
