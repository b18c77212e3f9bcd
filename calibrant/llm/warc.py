"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive is a skippable frame that holds the dictionary (itself compressed),
then one frame per record. Tasks write archives of bounded size into a shared
folder under names of their own; only those that a finished task reports are
read, so a lost executor or a repeated task leaves nothing behind that counts.
The reader loads the dictionary from the leading frame, decodes one frame per
record and checks version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm._arrow import small_batches
from calibrant.llm._state import keep, new_folder

#: Magic numbers of the format.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive, of its dictionary and of the samples for it.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 20, 32 << 10, 1 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Size of the table of repeated payloads up to which it is broadcast.
BROADCAST_ROWS = 400_000
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(name: Any, url: str | None, payload: bytes, digest: str, refers_to: Any, revisit: bool, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(name)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    head.append(f"WARC-Payload-Digest: {base32(digest)}")
    head.append(f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Left as they are in a target address; everything else, "%" included, is escaped so that it reads back the same.
SAFE = ":/?#[]@!$&'()*+,;=~"


def _urn(name: Any) -> str:
    return "<urn:page:>" if name is None else f"<urn:page:{quote(str(name), safe='')}>"


def _name(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:([^<>]+)>", urn or "")
    return unquote(found[1]) if found else None


def pack(records: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary trained on the first of them."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[: 64 << 10])  # only the dictionary sees samples; records are stored whole
        size += len(samples[-1])
    try:
        words = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples, k=256, d=8, level=3)
    except (zstandard.ZstdError, ValueError):
        words = None  # too few samples
    out = []
    if words is not None:
        packed = zstandard.ZstdCompressor(level=9).compress(words.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def unpack(archive: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, problem) for each frame; a broken frame ends the archive."""
    data, at, words = memoryview(archive), 0, None
    try:
        if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
            size = struct.unpack_from("<I", data, 4)[0]
            if 8 + size > len(data):
                raise zstandard.ZstdError("dictionary frame is cut off")
            packed, at = bytes(data[8 : 8 + size]), 8 + size
            if len(packed) >= 4 and struct.unpack_from("<I", packed)[0] == ZSTD_FRAME:
                packed = zstandard.ZstdDecompressor().decompress(packed)
            words = zstandard.ZstdCompressionDict(packed)
        press = zstandard.ZstdDecompressor(dict_data=words)
        while at < len(data):
            begin, parts = at, []
            frame = press.decompressobj()
            while not frame.eof:
                if at >= len(data):
                    raise zstandard.ZstdError("frame is cut off")
                piece = data[at : at + (64 << 10)]
                parts.append(frame.decompress(piece))
                at += len(piece)
            at -= len(frame.unused_data)
            yield begin, b"".join(parts), None
    except zstandard.ZstdError as error:
        yield at, None, str(error)


def parse(data: bytes) -> dict[str, Any]:
    """The fields of a record, with ``problem`` set if it breaks a rule."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    out: dict[str, Any] = {"record_type": None, "record_id": None, "refers_to": None, "uri": None, "date": None, "payload": None, "payload_bytes": None, "payload_digest": None, "problem": None}

    def bad(why: str) -> dict[str, Any]:
        return out | {"problem": why}

    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return bad("no version line or end of headers")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return bad(f"header without a name: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        return bad(f"no {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        return bad("length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return bad(f"block has {max(0, len(rest) - 4)} bytes, not {size}")
    block = rest[:size]
    out |= {"record_type": fields["warc-type"], "record_id": _name(fields["warc-record-id"]), "refers_to": _name(fields.get("warc-refers-to")), "uri": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "date": fields["warc-date"]}
    if fields.get("warc-block-digest") not in (None, base32(hashlib.sha1(block).hexdigest())):
        return bad("block digest differs")
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not mark or not length or not http.startswith(b"HTTP/"):
        return bad("no HTTP headers with a length")
    stated = fields.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", stated):
        return bad("no payload digest")
    out |= {"payload_bytes": int(length[1]), "payload_digest": base64.b32decode(stated[5:]).hex()}
    if out["record_type"] == "revisit":
        return bad("a revisit without its response or with a payload") if payload or "warc-refers-to" not in fields else out
    if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
        return bad("payload differs from its length or digest")
    return out | {"payload": payload}


def plan_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, url, payload, digest, revisit and refers_to of each row.

    Null html is an empty payload. Rows that share the largest page id are all
    responses; a null id never is the largest unless all of its group are null,
    and then all are responses. Payloads are compared by length and SHA-1, and
    only repeated ones are joined back: broadcast while few, else by digest.
    """
    content = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), content.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    large = F.col("n") >= REVISIT_BYTES
    first = keep(rows.where(large).groupBy("digest", "n").agg(F.max("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    joined = rows.join(first, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return joined.select("page", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``plan_records`` to archives; one row (name, records, bytes) for each.

    An empty table writes none. The rows are checkpointed: the archives are there.
    """
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        waiting: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            packed = pack(waiting)
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(packed)
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(waiting)], "bytes": [len(packed)]}, schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(record(row["page"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"], date))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return keep(records.mapInArrow(run, "name string, records long, bytes long"))


READ_SCHEMA = "archive string, offset long, record_type string, record_id string, refers_to string, uri string, date string, payload binary, payload_bytes long, payload_digest string, problem string"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder (those in ``manifest`` only, if given).

    A record that breaks a rule has its ``problem``; a broken frame gives one row
    and ends its archive. ``payloads=False`` leaves the payload column null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if manifest is not None:
        names = manifest.select("name")
        files = files.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "name", "left_semi")
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ_SCHEMA.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column(0)[k].as_py()
                for offset, data, problem in unpack(batch.column(1)[k].as_buffer()):
                    found = parse(data) if data is not None else {"problem": problem}
                    if not payloads:
                        found["payload"] = None
                    yield {"archive": archive, "offset": offset} | found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[dict] = []
        size = 0
        for row in rows(batches):
            part.append({n: row.get(n) for n in names})
            size += len(row.get("payload") or b"") + 200
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(part, schema=schema)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    return files.mapInArrow(run, READ_SCHEMA)


def require_whole(records: DataFrame, manifest: DataFrame) -> None:
    """Raise unless ``records`` (as read) are as many as ``manifest`` says, without a problem."""
    told = manifest.agg(F.sum("records")).first()[0] or 0
    n, bad, one = records.agg(F.count("*"), F.count("problem"), F.min("problem")).first()
    if bad or n != told:
        raise ValueError(f"archives hold {told} records; {n} were read, {bad} of them with a problem ({one})")


def archive_folder(spark: SparkSession) -> str:
    return new_folder(spark, "warc")
