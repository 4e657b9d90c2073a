"""The rows of run() against plain versions of what follows the classifier."""

from collections import Counter

import corpus_pipeline
import sentencepiece

from veracity.llm import decontaminate, pieces, pii

SF = "/root/testdata/sf0.001"


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    bags, root = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}
    sizes = {i: b.total() for i, b in bags.items()}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sizes[a] and sizes[b] and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and (both := sum((bags[a] & bags[b]).values())) >= 0.8 * (sizes[a] + sizes[b] - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in texts.items() if root[i] == i and not any(x in decontaminate.plain(t) for x in items)}
    field = pii.train(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i, t in left.items():
        base = pii.base_spans(t)
        want[i] = sp.encode(pii.redacted(t, [*base, *field.further(t, base)]))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: list(r["pieces"]) for r in rows} == want and len(rows) == len(want) < len(texts)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in rows)
