"""WARC records in gzip members, revisits for repeated payloads, and a reader that salvages damaged archives.

Archives are rows (archive, content) of bounded size, so that any store Spark reaches can hold them;
`export` writes them as files into a mounted folder. The reader checks every member and record; after a
failed check it looks for the next valid member or version line, goes on from there and logs the gap.

A null text is an empty payload, a null url an empty target. Repeated rows are separate records; rows of one id may
have different payloads, each is judged by its own. An empty table gives no archives. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut

MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES, MIN_REVISIT, STEP = 8 << 20, 1000, 1 << 16
ARCHIVES = "archive string, content binary"
RECORDS = "archive string, at bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
GAPS = "archive string, gap_start bigint, gap_end bigint, reason string, inner_start bigint, inner_end bigint"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record: response with its payload, or revisit without it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", re.sub(r"\s", "%20", url or "")),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, at: int = 0) -> dict | None:
    """The record at a place of `data`, with `size`; None if its head, length or digests are wrong. A record may lack a
    payload digest: a response then gets that of its payload."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or head_end < 0:
        return None
    fields = dict(x.split(": ", 1) for x in data[at + len(VERSION):head_end].decode("utf-8", "replace").split("\r\n") if ": " in x)
    try:
        n = int(fields["Content-Length"])
        kind, named = fields["WARC-Type"], fields["WARC-Block-Digest"]
        page_id = re.search(r"urn:page:(-?\d+|None)", fields["WARC-Record-ID"])[1]
        told = fields.get("WARC-Payload-Digest")
        told = told and base64.b32decode(told.removeprefix("sha1:")).hex()
    except (KeyError, ValueError, TypeError):
        return None
    end = head_end + 4 + n
    block = data[head_end + 4:end]
    if n < 0 or len(block) != n or data[end:end + 4] != b"\r\n\r\n":
        return None
    if named != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        return None
    http_end = block.find(b"\r\n\r\n")
    length = re.search(rb"Content-Length: (\d+)", block[:http_end + 2])
    refers = re.search(r"urn:page:(-?\d+)", fields.get("WARC-Refers-To", ""))
    payload = block[http_end + 4:]
    if kind != "revisit":
        own = hashlib.sha1(payload).hexdigest()
        if told and told != own:
            return None
        told = own
    return {"page_id": None if page_id == "None" else int(page_id), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": int(refers[1]) if refers else None, "payload_digest": told,
            "payload_bytes": int(length[1]) if length else len(payload), "payload": payload, "size": end + 4 - at}


def _inflated(content: bytes, at: int) -> tuple[bytes | None, int, str]:
    """Content of the gzip member at a place and its length there; None and a reason if its checks fail."""
    z, parts, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(content):
            parts.append(z.decompress(content[end:end + STEP]))
            end += STEP
    except zlib.error as e:
        return None, 0, f"member: {e}"
    if not z.eof:
        return None, 0, "truncated member"
    return b"".join(parts), min(end, len(content)) - len(z.unused_data) - at, ""


def _records_in(data: bytes):
    """Records of a member and the ranges between them that hold none."""
    at, lost = 0, None
    while at < len(data):
        r = parse_record(data, at)
        if r:
            if lost is not None:
                yield "gap", (lost, at)
                lost = None
            yield "record", r
            at += r["size"]
            continue
        lost = at if lost is None else lost
        at = data.find(VERSION, at + 1)
        at = len(data) if at < 0 else at
    if lost is not None:
        yield "gap", (lost, len(data))


def read_records(content: bytes):
    """(offset, record) and (start, end, reason, inner start, inner end) gaps of one archive, plain or compressed, in
    order. The inner range is set for a stretch inside the content of a whole member whose other records were read."""
    at, lost, why = 0, None, ""
    while at < len(content):
        found, inner, step = [], [], 0
        if content.startswith(MEMBER, at):
            data, step, why = _inflated(content, at)
            for kind, x in _records_in(data or b""):
                (found if kind == "record" else inner).append(x)
            if data is not None and not found:
                why = "bad record in a member"
        elif content.startswith(VERSION, at):
            r = parse_record(content, at)
            found, step, why = ([r], r["size"], "") if r else ([], 0, "bad record")
        else:
            why = "no member or version line"
        if found:
            if lost is not None:
                yield "gap", (lost[0], at, lost[1], None, None)
                lost = None
            for r in found:
                yield "record", (at, r)
            for x, y in inner:
                yield "gap", (at, at + step, "bad record in a member", x, y)
            at += step
            continue
        lost = lost or (at, why)
        nexts = [x for x in (content.find(MEMBER, at + 1), content.find(VERSION, at + 1)) if x >= 0]
        at = min(nexts) if nexts else len(content)
    if lost is not None:
        yield "gap", (lost[0], len(content), lost[1], None, None)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the largest id of the pages with the same payload, null for that page itself.

    Null ids never count as largest and revisit nothing; rows of one id with the same payload are all responses or all
    revisits, and rows of one id with different payloads are judged one by one."""
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    sized = cut(pages.select("page_id", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")), "payloads")
    large = sized.where(F.col("bytes") >= min_bytes)
    keeper = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = large.join(keeper, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return pages.select("page_id", "url", "html", digest.alias("digest")).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) of gzip members, one record each; a new one begins at `archive_bytes`."""
    def write(batches):
        from pyspark import TaskContext
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, html, refers in zip(b.page_id, b.url, b.html, b.refers_to):
                own = lambda v: None if pd.isna(v) else int(v)
                m = member(record_bytes(own(page_id), url, (html or "").encode("utf-8", "surrogatepass"), own(refers)))
                held.append(m)
                size += len(m)
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [f"{part:06d}-{n:06d}.warc.gz"], "content": [b"".join(held)]})
                    n, held, size = n + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"{part:06d}-{n:06d}.warc.gz"], "content": [b"".join(held)]})

    return planned.select("page_id", "url", "html", "refers_to").mapInPandas(write, ARCHIVES)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record that can be read, also behind damaged stretches."""
    def read(batches):
        for b in batches:
            for name, content in zip(b.archive, b.content):
                rows = []
                for kind, x in read_records(bytes(content or b"")):
                    if kind == "record":
                        r = x[1]
                        rows.append((name, x[0], r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"],
                                     r["payload"] if payloads else None))
                yield _frame(rows, RECORDS)

    return archives.select("archive", "content").mapInPandas(read, RECORDS)


def quarantined(archives: DataFrame) -> DataFrame:
    """Log of the byte ranges that no valid record covers."""
    def read(batches):
        for b in batches:
            for name, content in zip(b.archive, b.content):
                yield _frame([(name, *x) for kind, x in read_records(bytes(content or b"")) if kind == "gap"], GAPS)

    return archives.select("archive", "content").mapInPandas(read, GAPS)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in schema.split(", "):
        name, kind = c.split()
        if kind == "bigint":
            out[name] = out[name].astype("Int64")
    return out


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that every executor mounts."""
    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r.archive), "wb") as f:
                f.write(r.content)

    archives.foreachPartition(put)


def page_records(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    archives = cut(write_archives(plan_records(pages)), "archives")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m"""
