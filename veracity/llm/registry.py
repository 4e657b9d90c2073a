"""Queries of the corpus operators over the whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontaminate, extract, language, neardup, pieces, pii, quality, rules, substring, suffix, warc, whitening
from .common import shared_folder, table


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_posterior", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode it again, and give counts, a digest of the ids and whether the
    text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.round_trip(docs)
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive, rebuild the records, write them as WARC files, and read these back."""
    path = shared_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    warc.export_warc(warc.read_archive(spark, path), f"{path}/warc")
    return warc.described_files(warc.import_warc(spark, f"{path}/warc")).drop("digest_ok")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = extract.train(extract.text_blocks(extract.labelled_table(spark)))
    return extract.extract(table(spark, sf_dir, "pages"), tree).drop("n_blocks", "n_main_blocks")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = clusters.quantised(table(spark, sf_dir, "embeddings"))
    return clusters.cluster(points, clusters.first_centroids(points))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_crf, op2_suffix_dedup, op3_quality_bayes, op4_language_id, op5_decontaminate, op6_near_dedup, op7_quality_rules, op8_substring_dedup, op9_pieces, op10_warc,
        op11_main_text, op12_centroids, op13_whitening,
    )
}


_BITS = "('0x' || substr(h, {a}, 5))::BIGINT"
#: Rounds of op12: each vector's least distance * 16 + centroid, and the next centroids (floors of exact means).
_NEAREST = """
     a{i} AS (SELECT vec_id, any_value(v.x) AS x, min(16 * CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i]))) AS BIGINT) + k.c) AS best FROM v, k{i} AS k GROUP BY vec_id)"""
_MEANS = """
     s{i} AS (SELECT best % 16 AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY ALL),
     k{j} AS (SELECT k.c, coalesce(m.x, k.x) AS x FROM k{i} AS k LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY c) AS m USING (c))"""
_ROUNDS = ",".join(_NEAREST.format(i=i) + (("," + _MEANS.format(i=i, j=i + 1)) if i < 3 else "") for i in range(4))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL = {
    "op8_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d),
     s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p),
     r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM s) WHERE least < doc_id),
     c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(0, 50) AS t(o)),
     g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
     k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     j AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept FROM k ANTI JOIN c USING (doc_id, i) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
     p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d),
     w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
     r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
     g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
     n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
     s AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
     e AS (SELECT doc_id, span, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s
           UNION ALL SELECT doc_id, 0, 0, min(a) FROM s GROUP BY doc_id),
     k AS (SELECT e.doc_id, string_agg(CASE WHEN e.b IS NULL THEN substr(h, 2 * e.a + 1) ELSE substr(h, 2 * e.a + 1, 2 * (e.b - e.a)) END, '' ORDER BY e.a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id),
     c AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS f FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       {" || ".join(f"substr('{_LETTERS}', CAST((({_BITS.format(a=5 * i + 1)}) >> {s}) & 31 AS INT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM d""",
    "op12_centroids": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
     k0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT 16)),{_ROUNDS},
     o AS (SELECT vec_id, best % 16 AS c, best // 16 AS d FROM a3)
SELECT vec_id, CAST(o.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k3.x, ',')) AS centroid_sha256
FROM o JOIN k3 ON o.c = k3.c""",
    # The markup of these tables only: an article of paragraphs and a heading, and two kinds of references.
    "op11_main_text": """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
     b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>') AS w FROM a),
     c AS (SELECT page_id, url, list_transform(w, lambda s: trim(regexp_replace(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS w FROM b),
     d AS (SELECT page_id, url, array_to_string(list_filter(w, lambda s: s <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
}
