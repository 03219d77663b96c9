"""WARC archives in seekable Zstandard bundles.

Records are written in groups as independent Zstandard frames; a bundle ends with a seek table (the sizes of its frames) in a
skippable frame, so any zstd reader takes the file as a whole, and a reader with the index takes one frame. The index maps a record's
identifier to bundle, frame and offset within the decompressed frame.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes, that with the largest id is a response and the others are revisits
of it without payload. Who revisits whom is decided on digests alone; then html meets its decision once, dealt by id.
Bundles are written by tasks into a shared folder through a file system that pyarrow knows (local paths, HDFS, object stores): under a
temporary name first, then moved in place under a name that holds the task attempt, so a lost executor leaves no half bundle and a late or
speculative attempt never overwrites another's. The index names the bundles that count; those of attempts that lost are in no index. Reading back deals frames to tasks,
a few neighbouring ones at a time, and needs no more memory than a frame.

A record's identifier is made of page id and digest, so rows of one page id with other html are told apart; rows that repeat both are the same record written again, of the same role. Null html is an empty payload; null ids come before all
others and are written as "null"; a null url is written as empty. Target URIs are written as they are; line breaks, which a header can't hold, become their
percent codes there, and an extension header keeps the url itself. A record longer than a frame's size is a frame of its own. An empty table gives no bundles. Columns other than the three named are not
written, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, shared_dir, table

#: Bytes of records before a frame, and of frames before a bundle, is closed; zstd level; payloads below min_bytes are never revisits.
FRAME_BYTES, BUNDLE_BYTES, LEVEL, MIN_BYTES = 1 << 20, 64 << 20, 6, 0
#: Neighbouring frames that one task reads at least; from so many tasks on, each reads more of them.
FRAMES, TASKS, FRAMES_A_TASK = 4, 256, 256
#: Fixed values of the format: magic numbers of skippable frames with a seek table, and of its footer.
SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
_RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with its headers alone."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + (payload if refers_to is None else b"")
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if safe != (url or ""):
        head.append(f"X-Quoted-URL: {quote(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at a position."""
    split = data.index(b"\r\n\r\n", at)
    lines = data[at:split].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = split + 4
    end = start + int(headers["Content-Length"])
    payload = data[data.index(b"\r\n\r\n", start) + 4 : end]
    return headers, payload, end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes, with the footer at its end."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, FOOTER_MAGIC)
    return struct.pack("<II", SEEK_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(position, compressed, decompressed) of each frame of an open file."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes, frames, at = file.read(8 * count), [], 0
    for packed, plain in struct.iter_unpack("<II", sizes):
        frames.append((at, packed, plain))
        at += packed
    return frames


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, n, refers_to) of each distinct (id, digest, n): digests only, no html."""
    named = cut(pages.select("page_id", "sha", "n").distinct())
    copies = named.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("times"))
    copies = copies.where(F.col("times") > 1).drop("times")
    joined = named.join(copies, ["sha", "n"], "left")
    first = F.col("kept").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "sha", "n", F.when(~first, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the bundles below ``folder`` (a URI); the index, one row a record, with the bundle's URI. Eager: the index is kept in the shared folder."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    named = named.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    decided = roles(named, min_bytes).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("n").alias("m"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m"))
    dealt = named.join(decided, same).select("page_id", "url", "payload", "sha", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        prefix, bundles = f"{base}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        frame, held, frames, index, out, final = bytearray(), [], [], [], None, ""

        def close_frame():
            nonlocal frame, held
            packed = packer.compress(bytes(frame))
            out.write(packed)
            index.extend((i, p, f"{folder}/{final.rpartition('/')[2]}", len(frames), a, n) for i, p, a, n in held)
            frames.append((len(packed), len(frame)))
            frame, held = bytearray(), []

        def close_bundle():
            nonlocal out, frames, index, bundles
            if frame:
                close_frame()
            out.write(seek_table(frames))
            out.close()
            store.move(f"{final}.part", final)
            rows = pd.DataFrame(index, columns=["record_id", "page_id", "bundle", "frame", "offset", "length"]).astype({"page_id": "Int64"})
            out, frames, index = None, [], []
            bundles += 1
            return rows

        for part in batches:
            for page_id, url, payload, sha, refers_to in zip(part["page_id"], part["url"], part["payload"], part["sha"], part["refers_to"], strict=True):
                if out is None:
                    final = f"{prefix}-{bundles:04d}.warc.zst"
                    out = store.open_output_stream(f"{final}.part")
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                own = None if pd.isna(page_id) else int(page_id)
                made = record(own, url, payload, digest, None if pd.isna(refers_to) else int(refers_to))
                held.append((record_id(own, digest), own, len(frame), len(made)))
                frame += made
                if len(frame) >= FRAME_BYTES:
                    close_frame()
                    if sum(f[0] for f in frames) >= BUNDLE_BYTES:
                        yield close_bundle()
        if out is not None:
            yield close_bundle()

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return cut(dealt.mapInPandas(write, _INDEX))


def _rows(data: bytes, spots: list[tuple[int, int]] | None = None) -> Iterator[tuple]:
    at = [a for a, _ in spots] if spots is not None else [0]
    for start in at:
        while start < len(data):
            headers, payload, end = parse(data, start)
            name, refers = headers["WARC-Record-ID"][1:-1], headers.get("WARC-Refers-To")
            own = name.split(":")[2]
            url = unquote(headers["X-Quoted-URL"]) if "X-Quoted-URL" in headers else headers["WARC-Target-URI"]
            digest = headers["WARC-Payload-Digest"][5:]
            kind = headers["WARC-Type"]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"record {name}: its payload isn't that of its digest")
            page_id, refers_to = None if own == "null" else int(own), int(refers[1:-1].split(":")[2]) if refers else None
            yield name, page_id, url, int(headers["WARC-Payload-Length"]), digest, kind, refers_to, payload if kind == "response" else None
            start = len(data) if spots is not None else end


def _frames(batches: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    """Rows (bundle, frame, and maybe spots): opens a bundle once for the frames asked of it."""
    columns = [c.split()[0] for c in _RECORD.split(", ")]
    for part in batches:
        for bundle, asked in part.groupby("bundle"):
            store, path = fs.FileSystem.from_uri(bundle)
            size = store.get_file_info(path).size
            with store.open_input_file(path) as file:
                table_ = read_seek_table(file, size)
                for n, spots in zip(asked["frame"], asked["spots"] if "spots" in asked else [None] * len(asked), strict=True):
                    at, packed, plain = table_[n]
                    file.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                    rows = pd.DataFrame(list(_rows(data, None if spots is None else [(s["offset"], s["length"]) for s in spots])), columns=columns)
                    yield (rows if with_payload else rows.assign(payload=None)).astype({"page_id": "Int64", "refers_to": "Int64"})


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames in as many tasks as their number asks for, neighbours together."""
    frames = cut(frames)
    runs = frames.count() // FRAMES + 1
    tasks = min(runs, max(TASKS, runs * FRAMES // FRAMES_A_TASK))
    return frames.repartition(tasks, "bundle", F.floor(F.col("frame") / FRAMES)).sortWithinPartitions("bundle", "frame")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the index's frames, read whole; payloads are null for revisits and where not asked for."""
    frames = _dealt(index.select("bundle", "frame").distinct())
    return frames.mapInPandas(lambda it: _frames(it, with_payload), _RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the index's rows alone: each frame that holds some is read and unpacked once."""
    spots = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))
    return _dealt(spots).mapInPandas(lambda it: _frames(it, True), _RECORD)


def op6_warc(spark, sf_dir) -> DataFrame:
    """Every page's record, written to bundles and read back from them."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS kept FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda x: lpad(bin(('0x' || x)::INT), 4, '0')), '') AS b FROM s)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda k: (substr(b, (5 * i + k + 1)::INT, 1)::INT) * (1 << (4 - k)::INT)))::INT]), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM bits
"""
