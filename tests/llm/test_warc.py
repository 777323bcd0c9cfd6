import base64
import hashlib
import random
from collections import Counter

import pytest
import zstandard

from windrow.llm import warc

from .conftest import words

PAGES = "page_id long, url string, html string, digest string, payload string"


def page_rows(n=300):
    rng = random.Random(5)
    same = [f"<p>{words(rng, 30)}</p>" for _ in range(4)]
    rows = [(i, f"http://x/{i}", f"<html><p>{words(rng, 60)}</p></html>") for i in range(n)]
    rows += [(n + i, "http://y/\r\nWARC-Type: x", same[i % 3]) for i in range(100)] + [(n + 200, None, "")] * 2
    rows += [(n + 201, "u", None), (n + 202, "é \r\n\r\n", "é\r\n\r\nWARC/1.1"), (None, "u", same[3]), (None, None, same[3]), (-5, "u", same[3]), (n + 203, "u", words(rng, 40_000))]
    return [(*r, "x", "y") for r in rows]


def brute(rows, least):
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -(2**63)), -(2**63) if i is None else i)
    out = Counter()
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        largest = None if last[h or ""] == -(2**63) else last[h or ""]
        refers = largest if len(raw) >= least and i != largest else None
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
    return out


@pytest.mark.parametrize("least", [0, 1, 10_000])
def test_archives_against_brute_force(spark, least):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    got = Counter(tuple(r) for r in warc.write_and_read(pages, least).collect())
    assert got == brute(page_rows(), least)


def test_archives_are_plain_zstandard_files(spark, tmp_path):
    """Another decoder, with the dictionary, sees one stream of records."""
    rows = page_rows()
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/a")
    payloads = {(r.page_id, r.url): r.payload for r in warc.read_archives(spark, f"file://{tmp_path}/a", with_payload=True).collect()}
    assert payloads[0, "http://x/0"].decode() == rows[0][2]
    files = [f.read_bytes() for f in (tmp_path / "a").glob("part-*") if f.stat().st_size]
    assert sum(len(list(warc.records(f))) for f in files) == len(rows)
    for f in files:
        assert int.from_bytes(f[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(f[4:8], "little")
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(f[8 : 8 + size]))
        whole = zstandard.ZstdDecompressor(dict_data=known).stream_reader(f[8 + size :], read_across_frames=True).read()
        assert whole == b"".join(warc.records(f))


def test_broken_archives_are_noticed():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None)
    assert warc.parse_record(good)[:3] == (1, "u", b"abc")
    for bad in (good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good * 50)
    assert list(warc.records(frame + frame)) == [good * 50] * 2
    for bad in (frame[:-1], frame[:20], b"1234567890", frame + b"\x28"):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_empty(spark):
    assert warc.write_and_read(spark.createDataFrame([], PAGES)).count() == 0
