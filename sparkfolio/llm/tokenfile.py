"""Token files: ids under an adaptive context-mixing range coder, in independent, checksummed blocks.

Three orders predict each id. Order 2 and order 1 remember the id that last followed the two ids, or the one id, before it, and how often it has
held; their counts of hits in like states are added (so the order with more evidence weighs more) and stand beside order 0's counts of ids in one range, of which each id takes one part.
Ids new to order 0 follow as they are. A block of up to ``BLOCK`` ids starts from an empty model and carries the CRC-32 of its ids, so blocks are read alone and in any order, and damage is found.
Within a block the ids are lanes of up to ``STEPS``, coded side by side in numpy: all lanes learn into one model, remembered ids at each step, counts every few steps.

A file holds groups of whole documents (a block, or one longer document): a table of documents, the blocks' headers and the blocks; its footer lists the groups.
Files are ranges of the order by id, sorted by Spark (equal ids by text), one a task, named by task attempt; the folder's ``_index`` (Parquet) names the files and groups that count,
so those of lost attempts count nowhere. Where a group's ids start follows from the sizes of the files before it. Writers and readers hold one group, coded or decoded a block at a time.

Ids are below 65,536. Null texts are empty and have the end id alone; null document ids come first; rows that repeat an id are documents of their own, in order of their texts' hashes. Texts of any length are whole.
An empty table makes no groups, and no rows come back. Columns other than id and text play no part, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import VOCABULARY, encode_rows, forget, portions
from sparkfolio.llm.common import shared_dir, table

#: Most ids of a block, steps of its lanes, and ids beyond which it has twice the lanes of half the steps, which is faster and costs 1 % of its size.
BLOCK, STEPS, LARGE = 1 << 22, 2048, 1 << 20
#: The id that ends each document.
END = 2
#: Fixed values of the format.
MAGIC, FOOTER = b"TOKR\x02\x00\x00\x00", b"RKOT"
_GROUP, _HEAD = "<QQII", "<III"
#: Sum of order 0's counts; slots of order 2's predictions (a power of 2); most steps between two counts; bounds of a lane's range.
_TOTAL, _SLOTS, _OFTEN = 1 << 15, 1 << 17, 128
_LEAST, _FULL = 1 << 30, 1 << 62
_INDEX = "part int, file string, group int, offset long, length long, docs long, tokens long"


class _Encoder:
    """Range coder of many lanes: ranges of up to 62 bits and 32-bit digits. A digit keeps its carry as a 33rd bit, which goes to the digit before it at the end."""

    def __init__(self, lanes: int, steps: int):
        self.digits, self.used = np.empty((2 * steps + 1, lanes), np.int64), np.zeros(lanes, np.int64)
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)

    def code(self, lanes: np.ndarray | slice, under: np.ndarray | int, size: np.ndarray | int, total: np.ndarray | int):
        """Codes one symbol a lane: ``size`` of ``total`` counts, which stand above ``under`` others."""
        share = self.range[lanes] // total
        low, span = self.low[lanes] + share * under, share * size
        short = (span <= _LEAST).nonzero()[0]
        if len(short):
            at = short if isinstance(lanes, slice) else lanes[short]
            part, used = low[short], self.used[at]
            self.digits[used, at] = part >> 30
            self.used[at] = used + 1
            low[short] = (part & (_LEAST - 1)) << 32
            span[short] <<= 32
        self.low[lanes], self.range[lanes] = low, span

    def finish(self) -> bytes:
        """Numbers of the lanes' digits, and the digits."""
        rows = np.arange(int(self.used.max()) + 1)[:, None]
        digits = self.digits[: len(rows)]
        digits[self.used, np.arange(len(self.used))] = self.low + (_LEAST - 1) >> 30  # the rest is 0, as a reader takes it beyond the end
        digits[rows > self.used] = 0
        while (over := digits >> 32).any():
            digits &= 0xFFFFFFFF
            digits[:-1] += over[1:]
        return (self.used + 1).astype("<u4").tobytes() + digits.T[rows.T <= self.used[:, None]].astype("<u4").tobytes()


class _Decoder:
    def __init__(self, lanes: int, steps: int, coded: bytes):
        sizes, digits = np.frombuffer(coded, "<u4", lanes).astype(np.int64), np.frombuffer(coded, "<u4", offset=4 * lanes)
        if int(sizes.sum()) != len(digits) or int(sizes.max()) > 2 * steps + 1:
            raise ValueError("a block doesn't match its checksum")
        rows = np.zeros((int(sizes.max()) + 3, lanes), np.int64)
        rows[np.arange(len(digits)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(lanes), sizes)] = digits
        self.value, self.used = rows[0] << 30 | rows[1] >> 2, np.ones(lanes, np.int64)
        self.digits = (rows[:-1] & 3) << 30 | rows[1:] >> 2  # a value is two bits short of two digits
        self.range = np.full(lanes, _FULL, np.int64)

    def find(self, lanes: np.ndarray | slice, total: np.ndarray | int) -> np.ndarray:
        """Where in ``total`` each lane's next symbol lies; ``code`` then takes it."""
        self.share = self.range[lanes] // total
        return self.value[lanes] // self.share  # beyond the total in damaged data

    def code(self, lanes: np.ndarray | slice, under: np.ndarray | int, size: np.ndarray | int, total: np.ndarray | int):
        value, span = self.value[lanes] - self.share * under, self.share * size
        short = (span <= _LEAST).nonzero()[0]
        if len(short):
            at = short if isinstance(lanes, slice) else lanes[short]
            used = self.used[at]
            value[short] = (value[short] << 32 | self.digits[np.minimum(used, len(self.digits) - 1), at]) & (_FULL - 1)  # damaged data stay in bounds, for the checksum to find
            self.used[at] = used + 1
            span[short] <<= 32
        self.value[lanes], self.range[lanes] = value, span


class _Counts:
    """What the model has learnt by counting: order 0's ids, and how predictions fared in each state of the two orders."""

    def __init__(self):
        self.seen, self.escapes = np.zeros(0x10000, np.int64), 1
        self.fared = np.ones((2, 8, 3))  # by order, times held and whether both orders agree
        self.learn(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def learn(self, cases: np.ndarray, ids: np.ndarray):
        """Adds some steps' ids, and their states with what came of them (0: order 2 was right, 1: order 1, 2: neither), and shares the counts out anew."""
        made = np.bincount(cases, minlength=96).reshape(2, 4, 4, 3)  # agreement, order 1, order 2, outcome
        self.fared[0] += made.sum(axis=1).reshape(8, 3)
        self.fared[1] += made.sum(axis=2).reshape(8, 3)
        met = np.bincount(ids, minlength=0x10000)
        self.escapes += int(met[self.seen == 0].sum())
        self.seen += met
        # weights of both predictions beside order 0's counts: what both orders' states have met is added, so the one with more evidence weighs more
        mixed = self.fared[0].reshape(2, 1, 4, 3) + self.fared[1].reshape(2, 4, 1, 3)
        weights = np.clip(_TOTAL * mixed[..., :2] / mixed[..., 2:], 1, 16 * _TOTAL).astype(np.int64)
        weights[:, :, 0, 0] = 0  # nothing is remembered
        weights[:, 0, :, 1] = 0
        weights[1, :, 1:, 1] = 0  # order 2 says the same
        self.second, self.both = np.repeat(weights[..., 0].reshape(32), 3), np.repeat(weights.sum(axis=-1).reshape(32), 3)  # as cases are numbered
        # order 0: known ids share what is left beside that for new ones; where too many are known, the rarest count as new
        known = np.flatnonzero(self.seen)
        if len(known) > _TOTAL // 4:
            known = np.sort(known[np.argsort(-self.seen[known], kind="stable")[: _TOTAL // 4]])
        counts = self.seen[known]
        total = int(self.seen.sum()) + self.escapes
        new = min(max(1, _TOTAL * (total - int(counts.sum())) // total), _TOTAL // 2) if len(known) else _TOTAL
        size = 1 + counts * (_TOTAL - new - len(known)) // max(1, int(counts.sum()))
        if len(known):
            size[counts.argmax()] += _TOTAL - new - int(size.sum())
        # by id, and by place: id << 32 | counts below it << 16 | its own counts; new ids share the last counts, with -1 as their id
        ends, spare = np.cumsum(size), (_TOTAL - new << 16) + new - (1 << 32)
        own = known << 32 | ends - size << 16 | size
        self.places = np.full(0x10000, spare)
        self.places[known] = own
        self.ids = np.repeat(np.append(own, spare), np.append(size, new))


def _rows(n: int) -> tuple[int, int, int]:
    """Lanes of a block of ``n`` ids, their steps, and how many lanes have the last step."""
    lanes = -(-n // (STEPS if n <= LARGE else STEPS // 2))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _code(coder: _Encoder | _Decoder, n: int, ids: np.ndarray | None) -> np.ndarray:
    """Runs the model over all lanes in step; ``ids`` (a row a step) are known to an encoder and made by a decoder. ``n`` ids in all; the last step may have fewer lanes."""
    lanes, steps, last = _rows(n)
    decoded = np.zeros((steps, lanes), np.int64) if ids is None else ids
    cases = np.zeros((_OFTEN, lanes), np.int64)
    counts, counted = _Counts(), 0
    held_two, held_one = np.zeros(_SLOTS, np.int64), np.zeros(0x10000, np.int64)  # by order: id << 2 | times it held, at most 3
    one, mark = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for step in range(steps):
        if step - counted == min(_OFTEN, 1 + counted // 4):
            counts.learn(cases[: step - counted].reshape(-1), decoded[counted:step].reshape(-1))
            counted = step
        live = lanes if step < steps - 1 else last
        every, one, mark = slice(live), one[:live], mark[:live]
        place = (mark + one * 0x85EBCA6B >> 11) & (_SLOTS - 1)
        two, first = held_two.take(place), held_one.take(one)
        sure_two, sure_one = two & 3, first & 3
        second, least = two >> 2, first >> 2
        state = (second == least) * 48 + sure_one * 12 + sure_two * 3
        by_two, both = counts.second.take(state), counts.both.take(state)
        total = both + _TOTAL
        if ids is not None:
            found = ids[step, :live]
            spot = counts.places.take(found)
            right = (found == second) & (by_two > 0)
            other = (found == least) & (both > by_two) | right
        else:
            at = coder.find(every, total)
            spot = counts.ids.take(at - both, mode="clip")
            found = spot >> 32
            right, other = at < by_two, at < both
            np.copyto(found, least, where=other)
            np.copyto(found, second, where=right)
        under, size = both + (spot >> 16 & 0xFFFF), spot & 0xFFFF
        np.copyto(under, by_two, where=other)
        np.copyto(size, both - by_two, where=other)
        np.copyto(under, 0, where=right)
        np.copyto(size, by_two, where=right)
        coder.code(every, under, size, total)
        new = (spot < 0).nonzero()[0]
        if len(new):
            new = new[~other[new]]
            if ids is None:
                found[new] = np.minimum(coder.find(new, 0x10000), 0xFFFF)
            coder.code(new, found[new], 1, 0x10000)
        decoded[step, :live] = found
        cases[step - counted, :live] = state + 2 - other - right
        anew = found << 2 | 1
        held_two[place] = np.where(second == found, two + (sure_two < 3), np.where(sure_two > 1, two - 1, anew))
        held_one[one] = np.where(least == found, first + (sure_one < 3), np.where(sure_one > 1, first - 1, anew))
        mark, one = one * 0x9E3779B1, found
    return decoded


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(number of ids, CRC-32 of them as little-endian 32-bit integers, coded bytes) of each block."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("token ids must be below 65,536")
    out = []
    for at in range(0, len(ids), BLOCK):
        block = ids[at : at + BLOCK]
        lanes, steps, full = _rows(len(block))
        made = np.zeros((steps, lanes), np.int64)
        made[:, :full] = block[: full * steps].reshape(full, steps).T
        made[: steps - 1, full:] = block[full * steps :].reshape(lanes - full, steps - 1).T
        coder = _Encoder(lanes, steps)
        _code(coder, len(block), made)
        out.append((len(block), zlib.crc32(block.astype("<u4").tobytes()), coder.finish()))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> Iterator[np.ndarray]:
    """The ids of blocks, a block at a time; a block that doesn't match its checksum is an error."""
    for n, crc, coded in blocks:
        lanes, steps, full = _rows(n)
        made = _code(_Decoder(lanes, steps, coded), n, None).astype("<u4")
        found = np.concatenate([made[:, :full].T.reshape(-1), made[: steps - 1, full:].T.reshape(-1)])
        if zlib.crc32(found.tobytes()) != crc:
            raise ValueError("a block doesn't match its checksum")
        yield found


def pack_group(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """A group: numbers of documents, ids, blocks and packed bytes of the documents' table; that table; headers of blocks; blocks."""
    blocks = encode_blocks(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = zlib.compress(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + known.tobytes(), 1)
    heads = b"".join(struct.pack(_HEAD, n, crc, len(x)) for n, crc, x in blocks)
    return b"".join([struct.pack(_GROUP, len(doc_ids), len(ids), len(blocks), len(docs)), docs, heads, *(x for _, _, x in blocks)])


def unpack_group(data: bytes) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
    """(doc_id, ids before it in the group, number of ids, its ids in parts) of each document."""
    n_docs, n_ids, n_blocks, packed = struct.unpack_from(_GROUP, data)
    at = struct.calcsize(_GROUP)
    docs = zlib.decompress(data[at : at + packed])
    doc_ids, sizes, known = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u8", n_docs, 8 * n_docs).astype(np.int64), np.frombuffer(docs, np.uint8, n_docs, 16 * n_docs)
    at += packed
    heads = [struct.unpack_from(_HEAD, data, at + i * struct.calcsize(_HEAD)) for i in range(n_blocks)]
    at += n_blocks * struct.calcsize(_HEAD)
    blocks = []
    for n, crc, length in heads:
        blocks.append((n, crc, data[at : at + length]))
        at += length
    if sum(n for n, _, _ in blocks) != n_ids or int(sizes.sum()) != n_ids:
        raise ValueError("a group's blocks don't hold the ids of its documents")
    parts, held, used, before = decode_blocks(blocks), np.zeros(0, "<u4"), 0, 0
    for doc_id, n, k in zip(doc_ids.tolist(), sizes.tolist(), known, strict=True):
        own, left = [], n
        while left:
            if used == len(held):
                held, used = next(parts), 0
            own.append(held[used : used + left])
            left -= len(own[-1])
            used += len(own[-1])
        yield doc_id if k else None, before, n, own
        before += n


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, end: int = END) -> None:
    """Writes all texts' ids, each document's with the end id after it, in ascending order of ids as token files and ``_index`` below ``folder`` (a URI)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        out, rows, at = None, [], len(MAGIC)
        doc_ids, sizes, coded, total = [], [], [], 0

        def close_group():
            nonlocal doc_ids, sizes, coded, total, at
            packed = pack_group(doc_ids, sizes, np.concatenate(coded))
            out.write(packed)
            rows.append((task.partitionId(), f"{folder}/{name}", len(rows), at, len(packed), len(doc_ids), total))
            at += len(packed)
            doc_ids, sizes, coded, total = [], [], [], 0

        for batch in batches:
            if out is None and batch.num_rows:
                out = store.open_output_stream(f"{base}/{name}.tmp")
                out.write(MAGIC)
            known = batch.column(0).to_pylist()
            for first, n in portions(batch.column(1)):
                ids, lengths = encode_rows(batch.column(1).slice(first, n), path, [end])
                used = 0
                for doc_id, size in zip(known[first : first + n], lengths.tolist(), strict=True):
                    if doc_ids and total + size > BLOCK:
                        close_group()
                    doc_ids.append(doc_id)
                    sizes.append(size)
                    coded.append(ids[used : used + size])
                    used += size
                    total += size
        if out is None:
            return
        if doc_ids:
            close_group()
        forget(path)  # the worker may stay idle for a while
        out.write(b"".join(struct.pack("<QQ", r[3], r[4]) for r in rows) + struct.pack("<I", len(rows)) + FOOTER)
        out.close()
        store.move(f"{base}/{name}.tmp", f"{base}/{name}")
        columns = zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[c.split()[0] for c in _INDEX.split(", ")])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    ranged.mapInArrow(write, _INDEX).write.parquet(f"{folder}/_index")


def groups_of(uri: str) -> list[tuple[int, int]]:
    """(offset, length) of each group of a token file, from its footer."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        data = f.read_at(8, f.size() - 8)
        if data[4:] != FOOTER:
            raise ValueError("no token file")
        n = struct.unpack("<I", data[:4])[0]
        return [*struct.iter_unpack("<QQ", f.read_at(16 * n, f.size() - 8 - 16 * n))]


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of a folder, with ``start``: how many ids all groups before it hold."""
    index = spark.read.schema(_INDEX).parquet(f"{folder}/_index")
    files = index.groupBy("part").agg(F.sum("tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return index.join(files, "part").withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside")


def read_tokens(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the index's groups; ``ids`` (little-endian 32-bit integers) is null where not asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length, start in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "start")), strict=True):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    data = f.read_at(length, offset)
                rows = []
                for doc_id, before, n, parts in unpack_group(data):
                    crc = 0
                    for x in parts:
                        crc = zlib.crc32(x, crc)
                    rows.append((doc_id, start + before, n, crc, b"".join(x.tobytes() for x in parts) if with_ids else None))
                columns = zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    groups = index.select("file", "offset", "length", "start")
    return groups.repartition(groups.count() + 1).mapInArrow(read, schema)


def op13_token_files(spark, sf_dir) -> DataFrame:
    """Every document's place, number and checksum of ids, from token files written and read back."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(token_index(spark, folder), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
