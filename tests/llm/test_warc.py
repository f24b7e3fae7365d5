import gzip
import hashlib
import random

import pytest

from nocturne.llm import warc


def brute(pages):
    groups = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            groups[body] = max(groups.get(body, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        top = groups.get(body)
        again = top is not None and top != page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")


def round_trip(spark, pages, **more):
    chunks = warc.read_archives(warc.write_archives(warc.with_revisits(frame(spark, pages))), **more)
    return warc.payloads(chunks)


PAGES = [
    (1, "http://a/", "é" * 600),
    (2, "http://b/\r\nX: y", "é" * 600),
    (3, None, "é" * 600),
    (3, None, "é" * 600),
    (4, "", None),
    (5, "u", ""),
    (6, "u", "short"),
    (7, "u", "short"),
    (None, "u", "é" * 600),
    (8, "u", "\r\n\r\nWARC/1.0\r\n\r\n" * 200),
]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 28])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    out = round_trip(spark, PAGES).collect()
    assert all(r["intact"] for r in out)
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(PAGES)


def test_oversized_payloads_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 4096)
    rng = random.Random(1)
    pages = [(k, "u", "".join(rng.choice("abcdeé€𝄞") for _ in range(n))) for k, n in enumerate([0, 1, 4096, 4097, 50_000, 300_000])]
    records = warc.with_revisits(frame(spark, pages))
    assert warc.chunked(records, 4096).count() > len(pages)
    cut = warc.chunked(records, 4096)
    monkeypatch.setattr(warc, "chunked", lambda r: cut)
    chunks = warc.read_archives(warc.write_archives(records)).collect()
    for page_id, _, html in pages:
        mine = sorted((r for r in chunks if r["page_id"] == page_id), key=lambda r: r["chunk_no"])
        body, so_far = b"", hashlib.sha1()
        for r in mine:
            assert len(r["chunk"]) <= 4096
            body += r["chunk"]
            so_far.update(r["chunk"])
            assert (r["bytes_so_far"], r["sha1_so_far"]) == (len(body), so_far.hexdigest())
        assert body == html.encode() and [r["is_last"] for r in mine] == [False] * (len(mine) - 1) + [True]


def test_archives_are_plain_gzip_members(spark, tmp_path):
    manifest = warc.write_archives(warc.with_revisits(frame(spark, PAGES).coalesce(1)), f"file://{tmp_path}").collect()
    text = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in manifest)
    assert sum(r["n_records"] for r in manifest) == len(PAGES) and text.count(b"WARC-Type: revisit") == 3
    assert b"WARC-Target-URI: http://b/%0D%0AX:%20y\r\n" in text


def test_no_pages(spark):
    assert round_trip(spark, []).count() == 0


def test_the_same_where_joins_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "counted_broadcast", lambda df: df)
    assert sorted((tuple(r)[:5] for r in round_trip(spark, PAGES).collect()), key=str) == brute(PAGES)
