"""WARC archives: records, members, sidecars, revisits."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from assayframe.llm import warc_members as W


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    out, responses = [], set()
    for i, p in payloads:
        latest = max((j for j, q in payloads if q == p and j is not None), default=None)
        first = i == latest and (i, p) not in responses
        responses.add((i, p))
        if len(p) < least or first or len([1 for _, q in payloads if q == p]) == 1:
            out.append((i, len(p), digest(p), "response", None))
        else:
            out.append((i, len(p), digest(p), "revisit", latest))
    return sorted(out, key=repr)


def pages():
    r = random.Random(1)
    bodies = ["<p>é " + "x" * r.randrange(0, 300) + f"{i % 9}" for i in range(30)] + ["", None, "\r\n\r\nWARC/1.1\r\n\r\n", "long " * 300_000]
    rows = [(i, f"https://h.example/{i}\r\nX: y" if i % 3 else None, r.choice(bodies), "extra") for i in range(120)]
    return rows + [(119, "u", rows[119][2], "extra"), (None, "u", "without id", "extra"), (None, "u", rows[5][2], "extra"), (2**62, "u", rows[5][2], "extra")]


@pytest.mark.parametrize("size, least", [(64 << 20, 0), (5000, 0), (5000, 50)])
def test_round_trip(spark, monkeypatch, size, least):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", size)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, payload string").repartition(3)
    found = sorted((tuple(r) for r in W.archive_round_trip(df, least).collect()), key=repr)
    assert found == expected(pages(), least)
    assert W.archive_round_trip(df.limit(0)).collect() == []


def test_archives_on_disk(spark, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other")], "page_id long, url string, html string").coalesce(1)
    archives = W.normalise(W.revisits(W.write_streams(df, folder)), folder).collect()
    [stream], [name] = list(tmp_path.glob("*.stream.gz")), [a["file"] for a in archives]
    assert len(list(W.records(W.inflated(io.BytesIO(stream.read_bytes()))))) == 3
    unzip = zlib.decompressobj(31)
    unzip.decompress(stream.read_bytes())
    assert unzip.eof and not unzip.unused_data  # one member holds the whole stream
    data = (tmp_path / name).read_bytes()
    places = [tuple(map(int, line.split())) for line in (tmp_path / f"{name}.idx").read_text().splitlines()]
    assert [p[0] for p in places] == [0, places[0][1], places[0][1] + places[1][1]] and sum(p[1] for p in places) == len(data)
    members = [gzip.decompress(data[a : a + n]) for a, n in places]
    assert b"".join(members) == gzip.decompress(data)
    first, second, third = members
    assert b"WARC-Type: revisit\r\n" in first and b"WARC-Refers-To: <urn:page:2>" in first and not first.rstrip().endswith(b"same")
    assert second.endswith(b"same\r\n\r\n") and third.endswith(b"other\r\n\r\n") and b"WARC-Target-URI: http://c\r\n" in third


def test_broken_streams_are_refused():
    whole = W.record(1, "u", b"body", digest(b"body"))
    for cut in (len(whole) - 1, len(whole) // 2, 10):
        with pytest.raises(ValueError):
            list(W.records(iter([whole[:cut]])))
    chunks = (bytes([b]) for b in whole + whole)
    assert len(list(W.records(chunks))) == 2


def test_streams_of_several_members():
    one, two = W.record(1, "u", b"a" * 9999, digest(b"a")), W.record(2, None, b"", digest(b""))
    assert [h for h, _ in W.records(W.inflated(io.BytesIO(gzip.compress(one) + gzip.compress(two)), 64))] == [r.split(b"\r\n\r\n")[0] for r in (one, two)]
