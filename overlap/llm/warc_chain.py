"""WARC archives: writing pages, and reading them back by boundary-chain verification.

Writing: payloads are named by their SHA-1; the largest page_id of equal payloads is a response
record, the others are revisit records without a payload that refer to it. Payloads
that occur once are written where they are read; the others meet in a map-side aggregate that
keeps one (compressed) copy for each digest and task. Spark's text writer commits the archives
to the shared folder.

Reading: a task searches an archive for the record magic and emits, for every occurrence, the
candidate's offset and its successor's, from the lengths in the header. Pointer jumping from
offset 0 (all offsets at once, the jumps doubling in each round) keeps the reachable
candidates, so a magic inside a payload is not taken for a record. Headers may have any length. An archive holds at most
``MAX_RECORDS`` records, which bounds both the task and the group of candidates.

Defined cases: a null html is an empty payload; payloads shorter than ``min_bytes`` are all
responses; of rows repeated with the largest page_id one is the response and the others revisit
it; a page without an id keeps a null one; a broken chain yields the records before the break;
an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlap.llm.common import slices, staged
from overlap.session import scratch_path

MAGIC = b"WARC/1.1\r\n"
MAX_RECORDS = 2000
BROADCAST_DIGESTS = 100_000
DATE = "2000-01-01T00:00:00Z"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id: int | None, digest: str, kind: str, nth: int) -> str:
    h = hashlib.md5(f"{page_id} {digest} {kind} {nth}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload_bytes: int,
           refers_to: int | None, payload: bytes, nth: int) -> bytes:
    """One WARC record, its closing line breaks included."""
    block = b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    uri = (url or "").encode().translate(None, b"\r\n").decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest, kind, nth)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Payload-Bytes: {payload_bytes}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers_to, digest, 'response', 0)}"]
        if refers_to is not None:
            lines.append(f"WARC-Refers-To-Page: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=9).compress
    for batch in batches:
        for part in slices(batch, "html"):
            yield part.set_column(part.schema.get_field_index("html"), "html", pa.array(
                [pack(h) for h in part.column("html").to_pylist()], pa.binary()))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in slices(batch, "html"):
            out = [record(r["kind"], r["page_id"], r["url"], _base32(r["sha1"]), r["n"], r["head"],
                          unpack(r["html"]) if r["packed"] else r["html"] or b"", r["nth"])[:-1]
                   for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())],
                                             ["value"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` into archives under ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"), html.alias("html"))
            .withColumns({"sha1": F.unhex(F.sha1("html")), "n": F.octet_length("html").cast("long")}))
    key = ["sha1", "n"]
    small = rows.filter(F.col("n") >= min_bytes).drop("html")
    heads = staged(small.groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("top"),
                                           F.count("*").alias("rows")).filter("rows > 1").drop("rows"),
                   "warc-repeated")
    # digests that occur once need no exchange of their pages: few repeated digests are sent to
    # the tasks (at most BROADCAST_DIGESTS rows of 64 bytes), many are met in a join
    repeated = heads.select(*key)
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    none = F.lit(None).cast("long").alias("head")
    once = rows.join(repeated, key, "left_anti").select(
        *key, F.lit("response").alias("kind"), "page_id", "url", "html", F.lit(False).alias("packed"),
        none, F.lit(0).alias("nth"))
    again = rows.join(repeated, key, "left_semi").select(rows.columns)
    # the largest struct is that of the largest page_id; equal payloads never decide
    payloads = (again.mapInArrow(_squeeze, rows.schema).groupBy(*key)
                .agg(F.max(F.struct("page_id", "url", "html")).alias("top")))
    responses = payloads.select(*key, F.lit("response").alias("kind"), "top.page_id", "top.url",
                                "top.html", F.lit(True).alias("packed"), none, F.lit(0).alias("nth"))
    counted = (small.join(repeated, key, "left_semi").groupBy(*key, "page_id", "url")
               .agg(F.count("*").cast("int").alias("copies")))
    same = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    revisits = (counted.join(heads, key)
                .withColumn("nth", F.explode(F.expr("sequence(1, copies)")))
                .filter(~(same & (F.col("nth") == 1)))
                .select(*key, F.lit("revisit").alias("kind"), "page_id", "url",
                        F.lit(None).cast("binary").alias("html"), F.lit(False).alias("packed"),
                        F.col("top.page_id").alias("head"), "nth"))
    (once.unionByName(responses).unionByName(revisits).mapInArrow(_records, "value string")
     .write.option("lineSep", "\n").option("maxRecordsPerFile", MAX_RECORDS).text(path))


_CANDIDATE = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()),
                        ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64())])
_CANDIDATE_SQL = ("path string, offset long, successor long, page_id long, payload_bytes long, "
                  "payload_digest string, record_type string, refers_to long")


class _Headers:
    """Headers of an archive, asked for at increasing offsets; a header may have any length.

    Candidates before one blank line share its lines, which are read once: a field belongs to
    those that start before its last occurrence.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.end = data, -1

    def _read(self, start: int) -> None:
        self.fields, self.bad = {}, -1  # name: (offset, value); offset of the last line without a name
        while start <= self.end:
            stop = self.data.find(b"\r\n", start, self.end)
            stop = self.end if stop < 0 else stop
            name, colon, value = self.data[start:stop].partition(b":")
            if colon:
                self.fields[name.decode("latin-1").lower()] = start, value.strip()
            else:
                self.bad = start
            start = stop + 2

    def at(self, at: int) -> tuple[dict[str, str], int] | None:
        """Header fields of a candidate, and where its block starts."""
        first = at + len(MAGIC)
        if self.end < at:
            end = self.data.find(b"\r\n\r\n", at)
            self.end = len(self.data) if end < 0 else end
            self.blank = end >= 0
            if self.blank:
                self._read(first)
        if not self.blank or first > self.end or self.bad >= first:
            return None
        return ({name: value.decode("utf-8", "replace") for name, (start, value) in self.fields.items()
                 if start >= first}, self.end + 4)


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if value.lstrip("-").isascii() and value.lstrip("-").isdigit() else None


def candidates_of(path: str, data: bytes) -> Iterator[tuple]:
    """A row of _CANDIDATE for every occurrence of the magic that a header could follow."""
    headers = _Headers(data)
    at = data.find(MAGIC)
    while at >= 0:
        got = headers.at(at)
        length = _number(got[0], "content-length") if got else None
        if length is not None and length >= 0:
            fields, start = got
            after = start + length + 4
            if after <= len(data) and data[after - 4:after] == b"\r\n\r\n":
                size, digest = _number(fields, "warc-payload-bytes"), fields.get("warc-payload-digest", "")
                digest = digest.removeprefix("sha1:")
                if fields.get("warc-type") == "response":
                    head = data.find(b"\r\n\r\n", start, start + length)
                    payload = data[head + 4 if head >= 0 else start:start + length]
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                yield (path, at, after, _number(fields, "warc-page-id"), size, digest,
                       fields.get("warc-type"), _number(fields, "warc-refers-to-page"))
        at = data.find(MAGIC, at + 1)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = list(candidates_of(path, data.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _CANDIDATE)], schema=_CANDIDATE)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Mask of the candidates on the chain from offset 0, by pointer jumping."""
    n = len(offsets)
    order = np.argsort(offsets, kind="stable")
    at = np.searchsorted(offsets, successors, sorter=order)
    hit = order[np.minimum(at, n - 1)]
    jump = np.append(np.where(offsets[hit] == successors, hit, n), n)  # n: past the end
    reach = np.append(offsets == 0, False)
    while (jump[:n] < n).any():
        on = jump[np.flatnonzero(reach)]
        reach[on] = True
        jump = jump[jump]
    return reach[:n]


def _chain(rows: pa.Table) -> pa.Table:
    """The reachable rows of an archive; as Arrow, so that ids stay exact beside nulls."""
    keep = reachable(rows.column("offset").to_numpy(), rows.column("successor").to_numpy())
    return rows.filter(pa.array(keep)).sort_by("offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of the archives under ``path``, with archive and offset."""
    found = (spark.read.format("binaryFile").load(path).select("path", "content")
             .mapInArrow(_emit, _CANDIDATE_SQL))
    return found.groupBy("path").applyInArrow(_chain, _CANDIDATE_SQL)


def op1_warc_chain(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest",
                                             "record_type", "refers_to")
