"""The pipeline against the same decisions made plainly, stage by stage."""

import corpus_pipeline
import sentencepiece

from veracity.llm import decontaminate, neardup, pieces, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((docs.toPandas(), out.toPandas()))
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(list(b.columns) == columns for _, b in seen[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    before, after = seen[0]
    marked = before[before.doc_id.isin(labels.index)]
    right = marked.doc_id.isin(after.doc_id) == (labels.loc[marked.doc_id].to_numpy() == 1)
    assert right.mean() > 0.97
    before, after = seen[1]
    classes = neardup.near_classes(spark.createDataFrame(before)).toPandas().set_index("doc_id").class_id
    assert not after.text.duplicated().any() and set(after.doc_id) == set(classes) and len(after) < len(before)
    before, after = seen[2]
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = before.text.map(lambda t: any(i in decontaminate.plain(t) for i in items))
    assert not set(before[leak].doc_id) & set(after.doc_id) and set(before[~leak].doc_id) - set(after.doc_id) == set()
    before, after = seen[3]
    assert len(before) == len(after) and not after.text.map(pii.base_spans).map(bool).any()
    clean = before[~before.text.str.contains("[0-9@]", regex=True)]
    assert clean.merge(after, on="doc_id").eval("text_x == text_y").all()
    before, after = seen[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = before.set_index("doc_id").text
    assert len(after) == len(before) and all(list(p) == sp.encode(texts[i]) for i, p in zip(after.doc_id, after.pieces, strict=True))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
