import hashlib
import math
import zlib
from collections import Counter

import pytest

from tessel.llm import media
from tests.llm.helpers import TEXTS, awkward, empty


def test_interleaved_order_and_captions():
    page = '<p>One <b>two</b></p><figure><img src="sha256:%s" alt="alt"><figcaption>A &amp; b</figcaption></figure><p>Three</p><img src=x alt="y z"><script>"<img src=q>"</script>' % ("0" * 64)
    got = [(x["pos"], x["kind"], x["text"], x["caption"]) for x in media.interleave(page)]
    assert got == [(0, "text", "One two", None), (1, "image", None, "A & b"), (2, "text", "Three", None), (3, "image", None, "y z")]
    assert media.interleave(None) == media.interleave("") == []


def test_samples_are_lossless():
    for p in (b"", b"x", bytes(range(256)) * 3, b"\n\n255\n" * 64):
        x = media.pad(p)
        assert len(x) % 64 == 0 and len(x) > 0 and media.decode_samples(media.encode_samples(x)) == x
    with pytest.raises(ValueError):
        media.decode_samples(b"P5\n64 2\n255\n" + bytes(64))


def test_payloads_resolve(spark):
    docs = awkward(spark, TEXTS)
    pages = media.parse_interleaved(media.text_pages(docs), "doc_id", "n_bytes")
    found = media.resolve(pages, media.read_media(media.store_texts(docs))).collect()
    images = [r for r in found if r["kind"] == "image"]
    assert len(images) == docs.count()
    for r in images:
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]] or ""
            p = media.pad(t.encode())
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert r["media_sha256"] == hashlib.sha256(media.encode_samples(p)).hexdigest()
            assert r["feature"] == plain_feature(p)
            assert (r["caption"] or "") == (" ".join(t[:40].split()) or "text")
            # the reference comes after the first line and before the others, which are whole and in order
            lines = [" ".join(x.split()) for x in t.split("\n")]
            mine = sorted((x["pos"], x["text"]) for x in found if x["doc_id"] == r["doc_id"] and x["kind"] == "text")
            assert [x for p, x in mine if p < r["pos"]][:1] == [x for x in lines[:1] if x]
            assert {x for p, x in mine if p > r["pos"]} == {x for x in lines[1:] if x}


def plain_feature(p):
    n = len(p)
    mean = sum(p) / n
    dev = math.sqrt(sum((x - mean) ** 2 for x in p) / n)
    counts = Counter(p)
    entropy = max(0.0, -sum(c / n * math.log2(c / n) for c in counts.values()))
    rows = [sum(p[i : i + 64]) / 64 for i in range(0, n, 64)]
    step = sum(abs(a - b) for a, b in zip(rows, rows[1:])) / (len(rows) - 1) if len(rows) > 1 else 0.0
    bins = [sum(c for x, c in counts.items() if x // 32 == i) for i in range(8)]
    return f"{mean:.4f};{dev:.4f};{entropy:.4f};{step:.4f};" + ",".join(map(str, bins))


def test_real_pages_keep_order_and_captions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media.parse_interleaved(pages, "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        assert [x["pos"] for x in r["sequence"]] == list(range(len(r["sequence"]))) and len(r["sequence"]) > 0


def test_missing_payload_keeps_its_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:%s">' % ("f" * 64))], "doc_id long, html string")
    got = media.resolve(media.parse_interleaved(pages), spark.createDataFrame([], media.MEASURED)).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1] and got[1]["payload_bytes"] is None


def test_empty_table(spark):
    assert media.read_media(media.store_texts(empty(spark))).count() == 0
