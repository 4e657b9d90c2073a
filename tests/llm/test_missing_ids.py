"""Archive records of pages without an id."""

import base64
import hashlib

import pytest

from veracity.llm import warc


@pytest.mark.parametrize("least", [0, 3])
def test_warc_without_ids(spark, tmp_path, least):
    rows = [(None, "u", "only"), (None, "v", "only"), (None, "w", "with"), (7, "x", "with"), (9, "y", "with"), (None, None, None), (None, "z", "s"), (4, "z", "s")]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least)
    archive = warc.read_archive(spark, path)
    got = [tuple(r) for r in warc.described(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()]
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        if i is not None:
            first[(h or "").encode()] = min(i, first.get((h or "").encode(), i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= least and first.get(b, i) != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None, True))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in rows})
    assert sum("WARC-Record-ID: <urn:page:none>" in r["header"] for r in archive.collect()) == 5
