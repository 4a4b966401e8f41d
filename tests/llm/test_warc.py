import hashlib
import random

from netloom.llm import warc


def archive(n=30, level=3):
    rng = random.Random(1)
    members = [warc.member(warc.record_bytes(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(300 + i))), level) for i in range(n)]
    return members


def ids(content):
    return [x[1]["page_id"] for kind, x in warc.read_records(content) if kind == "record"]


def gaps(content):
    return [x[:2] for kind, x in warc.read_records(content) if kind == "gap"]


def test_round_trip():
    payload = "<p>é\r\n\r\nWARC/1.1\r\n</p>".encode() * 9
    for data in (warc.record_bytes(5, "http://x/ y", payload), warc.member(warc.record_bytes(5, "http://x/ y", payload))):
        (kind, (at, r)), = warc.read_records(data)
        assert (kind, at, r["payload"], r["payload_digest"], r["url"]) == ("record", 0, payload, hashlib.sha1(payload).hexdigest(), "http://x/%20y")


def test_later_records_survive_damage():
    members = archive()
    whole = b"".join(members)
    assert ids(whole) == list(range(30)) and gaps(whole) == []
    start = sum(map(len, members[:10]))
    broken = bytearray(whole)
    broken[start + 60:start + 90] = b"\0" * 30
    assert ids(bytes(broken)) == [i for i in range(30) if i != 10]
    assert gaps(bytes(broken)) == [(start, start + len(members[10]))]
    cut = whole[:start + 20] + whole[start + len(members[10]):]  # a member that ends early
    assert ids(cut) == [i for i in range(30) if i != 10] and gaps(cut) == [(start, start + 20)]
    assert ids(b"junk" + whole) == list(range(30)) and gaps(b"junk" + whole) == [(0, 4)]
    assert ids(whole[:-5]) == list(range(29)) and gaps(whole[:-5]) == [(len(whole) - len(members[29]), len(whole) - 5)]
    assert ids(b"") == [] and ids(b"\x1f\x8b\x08") == [] and gaps(b"nothing here") == [(0, 12)]


def test_plain_records_with_a_wrong_length():
    parts = [warc.record_bytes(i, "u", b"x" * 50) for i in range(5)]
    parts[2] = parts[2].replace(b"Content-Length: 1", b"Content-Length: 9", 1)
    assert ids(b"".join(parts)) == [0, 1, 3, 4]


def test_pages(spark, tmp_path):
    big = "x" * 1500
    pages = [(1, "a", big), (2, "b", big), (3, None, None), (4, "d", "small"), (5, "e", "small"), (6, "f", big), (6, "f", big), (7, "g", "é" * 600)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, archive string")
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(df).collect()), key=str)
    assert rows == sorted([(1, 1500, "revisit", 6), (2, 1500, "revisit", 6), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None),
                           (6, 1500, "response", None), (6, 1500, "response", None), (7, 1200, "response", None)], key=str)
    assert warc.page_records(df.limit(0)).collect() == []
    archives = warc.write_archives(warc.plan_records(df), archive_bytes=600)
    warc.export(archives, str(tmp_path))
    assert sum(len(ids(f.read_bytes())) for f in tmp_path.iterdir()) == 8
    assert warc.quarantined(archives).count() == 0
    damaged = spark.createDataFrame([("x", b"lost" + warc.member(warc.record_bytes(1, "u", b"p")))], warc.ARCHIVES)
    assert [tuple(r) for r in warc.quarantined(damaged).collect()] == [("x", 0, 4, "no member or version line", None, None)]


def test_records_without_or_with_wrong_payload_digest():
    plain = warc.record_bytes(1, "u", b"p" * 40)
    without = b"\r\n".join(x for x in plain.split(b"\r\n") if not x.startswith(b"WARC-Payload-Digest"))
    (_, (_, r)), = warc.read_records(without)
    assert (r["page_id"], r["payload_digest"]) == (1, hashlib.sha1(b"p" * 40).hexdigest())
    other = warc.record_bytes(2, "u", b"q" * 40)
    digest = lambda x: next(y for y in x.split(b"\r\n") if y.startswith(b"WARC-Payload-Digest"))
    wrong = plain.replace(digest(plain), digest(other))
    assert ids(wrong) == [] and ids(wrong + other) == [2] and ids(b"".join(map(warc.member, (without, wrong, other)))) == [1, 2]


def test_damage_inside_a_member_is_logged_where_it_is():
    a, b, c = (warc.record_bytes(i, "u", bytes([65 + i]) * 60) for i in range(3))
    content = warc.member(a + b.replace(b"B" * 20, b"x" * 20) + c)
    assert ids(content) == [0, 2]
    assert [x for kind, x in warc.read_records(content) if kind == "gap"] == [(0, len(content), "bad record in a member", len(a), len(a) + len(b))]


def test_one_id_with_several_payloads_and_null_ids(spark):
    big, other, third = "x" * 1500, "y" * 1500, "z" * 1200
    pages = [(1, big), (1, other), (2, big), (3, third), (1, third), (None, big), (None, third)]
    df = spark.createDataFrame([(i, "u", h, "d") for i, h in pages], "page_id bigint, url string, html string, digest string")
    rows = sorted(((r.page_id, r.payload_digest[:4], r.record_type, r.refers_to) for r in warc.page_records(df).collect()), key=str)
    d = lambda t: hashlib.sha1(t.encode()).hexdigest()[:4]
    assert rows == sorted([(1, d(big), "revisit", 2), (1, d(other), "response", None), (2, d(big), "response", None), (3, d(third), "response", None),
                           (1, d(third), "revisit", 3), (None, d(big), "response", None), (None, d(third), "response", None)], key=str)


def test_many_members_take_time_in_proportion():
    content = b"".join(warc.member(warc.record_bytes(i, "u", b"p" * 2000)) for i in range(3000))
    assert len(ids(content)) == 3000
