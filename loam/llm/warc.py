"""WARC writing and a salvage reader.

Writer: one record per page in gzip members, rolled into files of a bounded
size under a shared folder; every task returns the names of the files it
finished, so files of lost or repeated attempts are never read. Pages with
equal payloads share one response record (largest id); the others are revisit
records that refer to it.

Reader: parses member after member, checks gzip CRC, record length and payload
digest; after a failed check it searches for the next gzip member or plain
``WARC/`` version line that parses, recovers the later records, and reports the
skipped bytes as quarantined gaps. The same search runs over the inflated bytes
of a member, also over what a damaged one gives before the damage.

Defined cases: null html is an empty payload; null url becomes an empty target;
repeated page ids keep one row each; a page without an id is a response of its
own that nothing refers to, and reads back with a null id; very long payloads
are written and digested whole, one record at a time; an empty table writes no
file and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import cut_lineage, ensure_checkpoint_dir

#: A file is closed once it holds this many compressed bytes.
ROLL_BYTES = 16 << 20
#: Tasks that read archives, at most; each takes its files one after another.
READ_TASKS = 50_000
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = b"response" if refers_to is None else b"revisit"
    body = payload if refers_to is None else b""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
        b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + payload_digest(body).encode(),
        b"Content-Length: %d" % len(body),
    ]
    if refers_to is not None:
        head.insert(3, b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        head.insert(4, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _parse_record(buf: bytes, at: int) -> tuple[dict, int] | None:
    """The record at ``at`` and where it ends, or None if a check fails."""
    if buf[at:at + 5] != b"WARC/":
        return None
    end = buf.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = buf[at:end].split(b"\r\n")
    head = {}
    for line in lines[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        head[k.strip().lower()] = v.strip()
    raw = head.get(b"content-length", b"")
    if not raw.isdigit():
        return None
    stop = end + 4 + int(raw)
    if buf[stop:stop + 4] != b"\r\n\r\n":
        return None
    body = buf[end + 4:stop]
    said = head.get(b"warc-block-digest")
    if said is not None and said != b"sha1:" + payload_digest(body).encode():
        return None
    return {"head": head, "body": body}, stop + 4


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds and its end; the prefix before the
    damage and None if its checks fail."""
    d, parts, i = zlib.decompressobj(31), [], at
    try:
        while not d.eof and i < len(data):
            parts.append(d.decompress(data[i:i + step]))
            i += step
    except zlib.error:
        if step > 1:  # a failing call returns nothing, so its bytes go in one by one
            d, last = zlib.decompressobj(31), i
            parts = [d.decompress(data[k:k + step]) for k in range(at, last, step)]
            try:
                for k in range(last, min(last + step, len(data))):
                    parts.append(d.decompress(data[k:k + 1]))
            except zlib.error:
                pass
        return b"".join(parts), None
    if not d.eof:
        return b"".join(parts), None
    return b"".join(parts), min(i, len(data)) - len(d.unused_data)


def _raw_end(data: bytes, at: int, size: int, step: int = 1 << 16) -> int:
    """Where the first ``size`` inflated bytes of the member at ``at`` end."""
    d = zlib.decompressobj(31)
    while size > 0:
        feed = data[at:at + step]
        size -= len(d.decompress(feed, size))
        at += len(feed) - len(d.unconsumed_tail)
    return at


def _scan(plain: bytes, whole: bool) -> tuple[list[tuple[dict | None, int]], int]:
    """(record or None for a gap, end) over a member's inflated bytes, and the
    end of the last record. In a member that fails its checks (not ``whole``) a
    record needs a block digest, and the one that touches the damage is left out."""
    out: list[tuple[dict | None, int]] = []
    i = good = 0
    while i < len(plain):
        rec = _parse_record(plain, i)
        if rec is not None and (whole or (rec[1] < len(plain) and b"warc-block-digest" in rec[0]["head"])):
            i = good = rec[1]
            out.append((rec[0], i))
            continue
        i = plain.find(b"WARC/", i + 1)
        i = len(plain) if i < 0 else i
        if out and out[-1][0] is None:
            out.pop()
        out.append((None, i))
    return out, good


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """Yields ("record", start, end, record) and ("gap", start, end, None) over
    an archive's bytes, gzip members and plain records alike. What a member holds
    has the member's bytes as its place (of a damaged one: those up to its last
    record); a gap inside it is told in its turn among its records."""
    at, n, gap = 0, len(data), None
    while at < n:
        got: list[dict | None] = []
        end = at
        if data[at:at + 3] == b"\x1f\x8b\x08":
            plain, stop = _inflate(data, at)
            found, good = _scan(plain, stop is not None)
            if good:
                end = stop if stop is not None else _raw_end(data, at, good)
                got = [rec for rec, upto in found if stop is not None or upto <= good]
        elif data[at:at + 5] == b"WARC/":
            rec = _parse_record(data, at)
            if rec is not None:
                got, end = [rec[0]], rec[1]
        if got:
            if gap is not None:
                yield "gap", gap, at, None
                gap = None
            for r in got:
                yield "gap" if r is None else "record", at, end, r
            at = end
            continue
        if gap is None:
            gap = at
        tries = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/", at + 1)) if x >= 0]
        at = min(tries) if tries else n
    if gap is not None:
        yield "gap", gap, n, None


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html plus refers_to (null: response). Digest groups are
    pre-aggregated to one row each and joined with (id, digest) pairs only; the
    html is shuffled once, by its own page id, so a payload that a third of the
    pages share never meets in one task as text."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("_sha", F.sha1(F.encode("html", "UTF-8")))
    lead = base.groupBy("_sha").agg(F.max("page_id").alias("_lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = (
        base.select("page_id", "_sha")
        .distinct()
        .join(lead, "_sha")
        .where("_lead != page_id")
        .select("page_id", "_sha", F.col("_lead").alias("refers_to"))
    )
    return base.join(revisits, ["page_id", "_sha"], "left").drop("_sha")


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under ``folder`` (any URI that pyarrow opens) and
    returns the written manifest: path, n_records."""
    run_id = uuid.uuid4().hex

    def run(batches):
        ctx = TaskContext.get()
        out, base = pafs.FileSystem.from_uri(folder)
        out.create_dir(base, recursive=True)
        names, counts = [], []
        sink, size, n, seq = None, 0, 0, 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to")]
            for pid, url, html, ref in zip(*[c.to_pylist() for c in cols]):
                if sink is None:
                    name = f"{run_id}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{seq:05d}.warc.gz"
                    sink, size, n = out.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                payload = html.encode("utf-8", "replace")
                member = gzip_member(build_record(pid, url, payload, payload_digest(payload), ref))
                sink.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    sink.close()
                    names.append(f"{folder.rstrip('/')}/{name}")
                    counts.append(n)
                    sink, seq = None, seq + 1
        if sink is not None:
            sink.close()
            names.append(f"{folder.rstrip('/')}/{name}")
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "n_records"])

    plan = records.select("page_id", "url", "html", "refers_to")
    return cut_lineage(plan.mapInArrow(run, "path string, n_records long"))


READ_SCHEMA = (
    "path string, kind string, start_byte long, end_byte long, page_id long, url string, record_type string, "
    "refers_to long, payload_digest string, payload binary"
)


def _urn(v: bytes | None) -> int | None:
    if not v:
        return None
    try:
        return int(v.rpartition(b":")[2].rstrip(b">"))
    except ValueError:
        return None


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the files that ``manifest.path`` names with the salvage reader:
    one row per recovered record (kind 'record') and per quarantined byte gap
    (kind 'gap'). Each task holds one file at a time."""
    names = ["path", "kind", "start_byte", "end_byte", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
    fields = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    if not with_payload:
        names[-1], fields[-1] = "payload_bytes", pa.int64()

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                src, at = pafs.FileSystem.from_uri(path)
                with src.open_input_stream(at, compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                held = 0
                for kind, lo, hi, rec in salvage(data):
                    if rec is None:
                        rows.append((path, kind, lo, hi, None, None, None, None, None, None))
                    else:
                        h, body = rec["head"], rec["body"]
                        digest = h.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode() or None
                        rows.append((path, kind, lo, hi, _urn(h.get(b"warc-record-id")), h.get(b"warc-target-uri", b"").decode("utf-8", "replace"), h.get(b"warc-type", b"").decode(), _urn(h.get(b"warc-refers-to")), digest, body if with_payload else len(body)))
                        held += len(body)
                    if len(rows) >= 4096 or held >= (8 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names)

    schema = READ_SCHEMA if with_payload else READ_SCHEMA.replace("payload binary", "payload_bytes long")
    # a stated number of partitions: the names are so few bytes that adaptive
    # execution would put all files into one task
    files = manifest.count()
    return manifest.select("path").repartition(max(1, min(files, READ_TASKS)), "path").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit takes its payload's length
    from the response that it refers to."""
    manifest = write_archives(plan_records(pages), folder or archive_folder(spark))
    # narrow rows, written: every archive is read once, not again for the join's other side
    back = cut_lineage(read_archives(manifest, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    target = back.where("record_type = 'response'").groupBy("page_id").agg(F.max("payload_bytes").alias("_len")).withColumnRenamed("page_id", "refers_to")
    return back.join(target, "refers_to", "left").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("_len")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
