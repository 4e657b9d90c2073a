"""Classes of links that are found in two rounds."""

import random

from veracity.llm.neardup import components


def plain(links):
    least = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {n: low for n, low in least.items() if n != low}


def test_late_links_join_the_ties_of_classes(spark):
    rng = random.Random(5)
    links = [tuple(rng.sample(range(60), 2)) for _ in range(45)]
    early, late = links[:30], links[30:]
    classes = components(spark.createDataFrame(early, "a long, b long"))
    assert {r["node"]: r["class"] for r in classes.collect()} == plain(early)
    both = components(classes.toDF("a", "b").unionByName(spark.createDataFrame(late, "a long, b long")))
    assert {r["node"]: r["class"] for r in both.collect()} == plain(links)


def test_small_tables_lie_in_few_files(spark, tmp_path):
    """With many shuffle partitions a round of few links writes no file for each of them."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        links = [(i, i + 1) for i in range(0, 40) if i % 7]
        found = components(spark.createDataFrame(links, "a long, b long"))
        assert {r["node"]: r["class"] for r in found.collect()} == plain(links)
        parts = [len(list(d.glob("part-*"))) for d in tmp_path.glob("*/rdd-*")]
        assert len(parts) > 5 and sum(n > 8 for n in parts) <= 1  # the links as they come
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
