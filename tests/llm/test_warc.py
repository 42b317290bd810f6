import base64
import gzip
import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest

from tallyspark.llm import warc
from tallyspark.llm.common import shared_dir


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def rows():
    return [(1, "http://a/", "<p>x</p>"), (2, "http://b/ q", "<p>x</p>"), (3, None, None), (4, "u\nv", ""), (5, "http://c/", "ü" * 50000), (0, "http://z/", "<p>x</p>"), (7, "http://d/", "only\r\n\r\nWARC/1.1\r\n"), (7, "http://d/", "only\r\n\r\nWARC/1.1\r\n"), (None, "http://n/", "no id")]


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "1 as first", "'x' as sha1", "true as revisit").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in rows():
        data = (html or "").encode()
        same = [j for j, _, h in rows() if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        revisit = len(same) > 1 and first != i
        want.append((i, len(data), digest(data), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, least=5).collect()}
    assert got[4] == got[3] == "response" and got[2] == "revisit"


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"{shared_dir(spark)}/t-payloads", archive_bytes=100)
    assert manifest.count() > 3
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest).collect() if r.record_type == "response"}
    assert got[5] == ("ü" * 50000).encode() and got[3] == b""


def archive(n, packed):
    rng = random.Random(n)
    parts = []
    for i in range(n):
        body = bytes(rng.choices(b"abc \r\nWARC/1.0", k=rng.randint(0, 3000)))
        record = warc.record_bytes(i, f"http://h/{i}", body, digest(body), None, False)
        parts.append((body, gzip.compress(record) if packed else record))
    return parts


def read(data):
    out = list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))
    at = 0
    for kind, start, stop, inner, _, _ in out:
        assert start == at or inner is not None and start <= at
        at = stop
    return out, at


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    parts = archive(30, packed)
    out, end = read(b"".join(p for _, p in parts))
    assert [k for k, *_ in out] == ["record"] * 30 and [r["payload"] for *_, r in out] == [b for b, _ in parts]
    assert end == sum(len(p) for _, p in parts)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "insert", "tail"])
def test_salvage(packed, harm):
    parts = archive(20, packed)
    data = [bytearray(p) for _, p in parts]
    bad = 7
    if harm == "flip":
        data[bad][len(data[bad]) // 2] ^= 0xFF
    elif harm == "cut":
        del data[bad][len(data[bad]) // 3 :]
    elif harm == "insert":
        data[bad] = bytearray(b"\x1f\x8b\x08junk WARC/1.x ") + data[bad]
    else:
        bad = 19
        del data[bad][-20:]
    whole = b"".join(data)
    out, end = read(whole)
    want = [b for i, (b, _) in enumerate(parts) if i != bad or harm == "insert"]
    assert [r["payload"] for k, *_, r in out if k == "record"] == want
    gaps = [(a, b) for k, a, b, *_ in out if k == "gap"]
    start = sum(map(len, data[:bad]))
    assert len(gaps) == 1 and gaps[0][0] == start and end == len(whole)


def members(n, each):
    """(bodies, their records) of n members of `each` records."""
    rng = random.Random(each)
    out = []
    for m in range(n):
        bodies = [bytes(rng.choices(range(256), k=rng.randint(10, 4000))) for _ in range(each)]
        out.append((bodies, [warc.record_bytes(m * each + i, "http://h/", b, digest(b), None, False) for i, b in enumerate(bodies)]))
    return out


def payloads(out):
    return [r["payload"] for k, *_, r in out if k == "record"]


def test_records_beside_a_damaged_one_come_back():
    made = members(3, 5)
    records = [list(r) for _, r in made]
    harmed = bytearray(records[1][2])
    harmed[-20] ^= 1  # of the payload; the member is packed after that, so its checksum is right
    records[1][2] = bytes(harmed)
    packed = [gzip.compress(b"".join(r)) for r in records]
    out, end = read(b"".join(packed))
    assert payloads(out) == [b for m, (bodies, _) in enumerate(made) for i, b in enumerate(bodies) if (m, i) != (1, 2)]
    gaps = [g[1:5] for g in out if g[0] == "gap"]
    a = len(records[1][0] + records[1][1])
    assert gaps == [(len(packed[0]), len(packed[0] + packed[1]), a, a + len(harmed))] and end == sum(map(len, packed))


@pytest.mark.parametrize("level", [0, 6])
def test_what_inflates_of_a_cut_member_comes_back(level):
    made = members(3, 40)
    packed = [bytearray(gzip.compress(b"".join(r), level)) for _, r in made]
    del packed[1][len(packed[1]) * 2 // 3 :]
    out, end = read(b"".join(packed))
    got = payloads(out)
    cut = len(got) - 80
    assert 20 <= cut < 40 and got == made[0][0] + made[1][0][:cut] + made[2][0]
    assert sum(k == "gap" for k, *_ in out) == 1 and end == sum(map(len, packed))


@pytest.mark.parametrize("level", [0, 6])
def test_wrong_checksum_or_damaged_stream(level):
    made = members(3, 40)
    packed = [bytearray(gzip.compress(b"".join(r), level)) for _, r in made]
    packed[1][-6] ^= 1
    out, _ = read(b"".join(packed))
    assert payloads(out) == [b for bodies, _ in made for b in bodies] and all(r["verified"] for *_, r in out if r)
    assert [g[2] for g in out if g[0] == "gap"] == [len(packed[0] + packed[1])]
    packed[1][-6] ^= 1
    packed[1][len(packed[1]) // 2] ^= 0xFF
    got = payloads(read(b"".join(packed))[0])
    every = [b for bodies, _ in made for b in bodies]
    assert got[:40] == every[:40] and got[-40:] == every[-40:] and set(got) <= set(every) and 55 <= len(got) < 120 and len(got) == len(set(got))


def test_digests_by_their_names():
    body = b"some body"
    good = {"sha256 hex": "sha256:" + hashlib.sha256(body).hexdigest(), "sha1 hex": "sha1:" + hashlib.sha1(body).hexdigest().upper(), "sha256 base32": "SHA-256:" + base64.b32encode(hashlib.sha256(body).digest()).decode(), "md5 base64": "md5:" + base64.b64encode(hashlib.md5(body).digest()).decode(), "unknown": "blake9:zz"}
    record = warc.record_bytes(1, "u", body, "X", None, False)
    for name, stated in good.items():
        out, _ = read(record.replace(b"sha1:X", stated.encode()))
        assert payloads(out) == [body] and out[0][-1]["digest"] == digest(body) and out[0][-1]["verified"] == (name != "unknown"), name
        if name != "unknown":
            out, _ = read(record.replace(b"sha1:X", stated.encode()).replace(body, b"some b0dy"))
            assert payloads(out) == [], name
    block = record[record.index(b"HTTP/") : -4]
    for wrong in (False, True):
        stated = b"WARC-Block-Digest: sha1:" + digest(block + b"x" * wrong).encode() + b"\r\nContent-Type"
        assert len(payloads(read(record.replace(b"sha1:X", b"").replace(b"Content-Type", stated, 1))[0])) == (not wrong)


def test_large_member_is_read_forwards():
    made = members(1, 400)
    bodies = made[0][0]
    data = gzip.compress(b"".join(made[0][1]), 1)
    source = warc.Source(io.BytesIO(data), len(data))
    member = warc.Member(source, 0)
    assert member.whole and member.stop == len(data) and member.size > 2 * warc.CHUNK
    most = 0
    got = []
    for _, _, record in warc.records_in(member):
        got.append(record["payload"])
        most = max(most, len(member.held))
    assert got == bodies and most < 3 * warc.CHUNK


def test_members_without_records_and_revisits():
    revisit = warc.record_bytes(2, "u", b"x", digest(b"x"), 1, True)
    out, _ = read(gzip.compress(b"no record") + gzip.compress(revisit) + gzip.compress(b"") + revisit)
    assert [(k, r and (r["digest"], r["verified"])) for k, *_, r in out] == [("gap", None), ("record", (digest(b"x"), True)), ("gap", None), ("record", (digest(b"x"), False))]


def test_a_gap_is_logged_by_the_job(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "text %d " % i * 40) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"{shared_dir(spark)}/t-gap")
    path = manifest.first().path
    system, root = pafs.FileSystem.from_uri(path)
    data = bytearray(system.open_input_file(root).read())
    middle = data.index(warc.MAGIC, len(data) // 2) + 60  # in a member's body: nothing checks some header bytes
    data[middle] ^= 0x55
    with system.open_output_stream(root, compression=None) as f:
        f.write(bytes(data))
    got = warc.read_archives(manifest).collect()
    assert sum(r.kind == "gap" for r in got) == 1 and sum(r.kind == "record" for r in got) == 39
