"""Token ids as length-delimited binary records (operator 8).

A shard is a file of records

    length        uint64
    masked CRC    uint32, of the length's 8 bytes
    data          ``length`` bytes
    masked CRC    uint32, of the data

with a separate index file beside it (``.idx``): the record count, then each
record's offset, all uint64.  Integers are little-endian; the CRC is CRC-32C,
masked as rotated right by 15 bits plus 0xA282EAD8.  The data of a record are
an int64 document id, a uint32 that is 1 if the id is null, a uint32 with the
width of a token id in bytes (2 or 4), and the ids.

Spark range-partitions the documents by id and sorts each partition; each task
streams its partition into a shard with a name of its own attempt, and only
the shards that successful tasks report are in the manifest, so lost executors
and repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import groups
from .common import worker_cache
from .pretokens import split_many

END_ID = 2
CACHE_ENTRIES = 500_000
HEADER = np.dtype([("id", "<i8"), ("null", "<u4"), ("width", "<u4")])
MASK_DELTA = 0xA282EAD8
#: Bytes of a lane of the vectorised checksum, and of the data summed at a time.
LANE = 256
PACK = 4 << 20
#: Up to here strings of one size are summed as they are.
SHORT = 16


# --- CRC-32C, many byte strings at a time --------------------------------------

def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table for two bytes at a time, and two tables that move a checksum past
    LANE zero bytes (low and high half)."""
    cache = worker_cache("crc")
    if "t" not in cache:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0x82F63B78), byte >> 1)
        pair = np.arange(65536, dtype=np.uint32)
        for _ in range(2):
            pair = byte[pair & 0xFF] ^ (pair >> 8)
        low, high = np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << 16
        for _ in range(LANE // 2):
            low, high = (pair[x & 0xFFFF] ^ (x >> 16) for x in (low, high))
        cache["t"] = pair, low, high
    return cache["t"]


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string of at least 4 bytes.

    With a start value of zero, leading zero bytes change nothing; the usual
    start value is the same as inverting the first four bytes.  So each string
    is padded in front to whole lanes, all lanes are summed side by side, and a
    string's lanes are joined by moving the sum past a lane.
    """
    pair, low, high = _crc_tables()
    if not rows:
        return np.zeros(0, np.uint32)
    size = np.array([len(r) for r in rows])
    if size[0] <= SHORT and size[0] % 2 == 0 and (size == size[0]).all():      # as the lengths are: no lanes
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).copy()
        flat[:, :4] ^= 0xFF
        crc = np.zeros(len(rows), np.uint32)
        for column in np.ascontiguousarray(flat.view("<u2").T):
            crc = pair[(crc ^ column) & 0xFFFF] ^ (crc >> 16)
        return crc ^ np.uint32(0xFFFFFFFF)
    lanes = -(-size // LANE)
    stop = np.cumsum(lanes)
    flat = np.zeros(int(stop[-1]) * LANE, np.uint8)
    for row, end in zip(rows, (stop * LANE).tolist()):
        flat[end - len(row):end] = np.frombuffer(row, np.uint8)
    begin = stop * LANE - size
    for k in range(4):
        flat[begin + k] ^= 0xFF
    columns = np.ascontiguousarray(flat.view("<u2").reshape(-1, LANE // 2).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = pair[(crc ^ column) & 0xFFFF] ^ (crc >> 16)
    first = stop - lanes
    out = np.zeros(len(rows), np.uint32)
    order = np.argsort(-lanes, kind="stable")
    sorted_lanes = -lanes[order]
    for j in range(int(lanes.max())):
        active = order[: np.searchsorted(sorted_lanes, -j, "left")]
        x = out[active]
        out[active] = low[x & 0xFFFF] ^ high[x >> 16] ^ crc[first[active] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


# --- tokens ---------------------------------------------------------------------

def _byte_letters() -> str:
    """The letter of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes in order for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return "".join(chr(b if b in plain else 0x100 + others.index(b)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class _Merged(dict):
    """piece -> its ids (bytes), merged by the library when first asked for."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        # a piece in the file's byte letters goes right to the library's merges
        if piece.isascii() and piece.isprintable():         # of these only the space has another letter
            letters = piece.replace(" ", _BYTE_LETTERS[32])
        else:
            letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = self[piece] = array("I", [t.id for t in self.merge(letters)]).tobytes()
        return ids


def _default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(text: F.Column, path: str | None = None, end_id: int | None = END_ID) -> F.Column:
    """Column of token ids (little-endian uint32 bytes) of a text column by a
    byte-level BPE file of the tokenizers library, without special tokens but
    for ``end_id`` after each text.  The library merges each distinct piece of a
    worker's texts once; a text that holds the string of an added token goes
    to it whole.  A null text counts as empty."""
    path = path or _default_path()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    @arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        tokenizer, added, known = _tokenizer(path)
        out = []
        for group in groups(texts.to_pylist(), 1 << 20):
            split = split_many([t or "" for t in group])
            for text, pieces in zip(group, split):
                if text and any(a in text for a in added):
                    ids = tokenizer.encode(text, add_special_tokens=False).ids
                    out.append(np.array(ids, "<u4").tobytes() + tail)
                else:
                    out.append(b"".join([known[p] for p in pieces]) + tail)
        return pa.array(out, pa.binary())
    return run(text)


def _tokenizer(path: str):
    cache = worker_cache("tokenizer")
    if path not in cache:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        cache[path] = tokenizer, added, _Merged(tokenizer.model.tokenize)
    return cache[path]


# --- files ----------------------------------------------------------------------

def _filesystem(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _frames(ids: list, bodies: list[bytes], width: int) -> tuple[list[bytes], np.ndarray]:
    """Framed records, and each one's size."""
    tokens = np.frombuffer(b"".join(bodies), "<u4")
    if len(tokens) and int(tokens.max()) >> (8 * width):
        raise ValueError(f"a token id does not fit into {width} bytes")
    narrow = tokens.astype(f"<u{width}").tobytes()
    head = np.zeros(len(ids), HEADER)
    head["id"], head["null"], head["width"] = [i or 0 for i in ids], [i is None for i in ids], width
    heads, step = head.tobytes(), HEADER.itemsize
    ends = np.cumsum([len(body) // 4 * width for body in bodies]).tolist()
    data = [heads[k * step:(k + 1) * step] + narrow[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends))]
    lengths = [len(d).to_bytes(8, "little") for d in data]
    heads, tails = masked(crc32c_many(lengths)), masked(crc32c_many(data))
    frames = [n + int(h).to_bytes(4, "little") + d + int(t).to_bytes(4, "little")
              for n, h, d, t in zip(lengths, heads, data, tails)]
    return frames, np.array([len(f) for f in frames], np.int64)


MANIFEST = "shard int, path string, n_records long, n_ids long"


def write_records(docs: DataFrame, folder: str, width: int = 4) -> DataFrame:
    """The manifest, one row per shard, of columns id (long) and ids (bytes,
    uint32), written a shard for each partition as they are ordered.  Running
    the result's plan writes the files."""
    def write(batches):
        shard = TaskContext.get().partitionId()
        name = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.rec"
        store, path = _filesystem(name)
        out, sizes, n_ids = None, [], 0
        for batch in batches:
            ids, bodies = batch.column("id").to_pylist(), batch.column("ids").to_pylist()
            at = 0
            while at < len(bodies):
                end, size = at, 0
                while end < len(bodies) and (size < PACK or end == at):
                    size += len(bodies[end])
                    end += 1
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                frames, size_of = _frames(ids[at:end], bodies[at:end], width)
                out.write(b"".join(frames))
                sizes.append(size_of)
                n_ids += size // 4
                at = end
        if out is None:
            return
        out.close()
        sizes = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8")
        with store.open_output_stream(path + ".idx") as index:
            index.write(len(offsets).to_bytes(8, "little") + offsets.tobytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "path": [name],
            "n_records": pa.array([len(offsets)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return docs.mapInArrow(write, MANIFEST)


def _ids_of(data: bytes) -> tuple[int | None, bytes]:
    head = np.frombuffer(data, HEADER, 1)[0]
    ids = np.frombuffer(data, f"<u{head['width']}", offset=HEADER.itemsize).astype("<u4")
    return None if head["null"] else int(head["id"]), ids.tobytes()


def _checked(block: bytes, where: list[int]) -> list[bytes]:
    """The data of the records at these offsets of a block, checksums verified."""
    lengths = [block[o:o + 8] for o in where]
    data = [block[o + 12:o + 12 + int.from_bytes(n, "little")] for o, n in zip(where, lengths)]
    stored = np.array([[int.from_bytes(block[o + 8:o + 12], "little"),
                        int.from_bytes(block[o + 12 + len(d):o + 16 + len(d)], "little")]
                       for o, d in zip(where, data)], np.uint32).reshape(-1, 2)
    if (stored[:, 0] != masked(crc32c_many(lengths))).any() or \
            (stored[:, 1] != masked(crc32c_many(data))).any():
        raise ValueError("a record's checksum is wrong")
    return data


def record_offsets(path: str) -> np.ndarray:
    """Offsets of a shard's records, from its index file."""
    store, local = _filesystem(path + ".idx")
    with store.open_input_stream(local) as f:
        raw = f.read()
    return np.frombuffer(raw, "<u8", offset=8, count=int.from_bytes(raw[:8], "little")).astype(np.int64)


def read_record(path: str, number: int) -> tuple[int | None, bytes]:
    """One record by its number: (id, ids), read at its offset alone."""
    offset = int(record_offsets(path)[number])
    store, local = _filesystem(path)
    with store.open_input_file(local) as f:
        size = int.from_bytes(f.read_at(8, offset), "little")
        return _ids_of(_checked(f.read_at(size + 16, offset), [0])[0])


def read_records(manifest: DataFrame) -> DataFrame:
    """Rows of the shards of a manifest: shard, number, id, ids (uint32 bytes)
    and before (ids of the shard's earlier records)."""
    def read(batches):
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                offsets = record_offsets(name)
                store, local = _filesystem(name)
                with store.open_input_file(local) as f:
                    ends = np.append(offsets[1:], f.size())
                    at, before = 0, 0
                    while at < len(offsets):
                        end = max(at + 1, int(np.searchsorted(ends, offsets[at] + PACK, "right")))
                        block = f.read_at(int(ends[end - 1] - offsets[at]), int(offsets[at]))
                        rows = [_ids_of(d) for d in _checked(block, (offsets[at:end] - offsets[at]).tolist())]
                        n = np.array([len(r[1]) // 4 for r in rows], np.int64)
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([shard] * len(rows), pa.int32()),
                            "number": pa.array(range(at, end), pa.int64()),
                            "id": pa.array([r[0] for r in rows], pa.int64()),
                            "ids": pa.array([r[1] for r in rows], pa.binary()),
                            "before": pa.array(before + np.cumsum(n) - n, pa.int64())})
                        before += int(n.sum())
                        at = end

    one_each = manifest.repartitionByRange(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return one_each.mapInArrow(read, "shard int, number long, id long, ids binary, before long")


def write_texts(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None,
                end_id: int | None = END_ID, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize a table of documents and write it as shards; the manifest is
    written beside them (``folder``/manifest) and returned.

    Null and empty texts give a record with the end id alone; rows with a null
    id come first; repeated ids give a record each, in any order among
    themselves.  An empty table gives an empty manifest.  Other columns are not
    read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(shards, F.col("id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("id").asc_nulls_first())
    coded = ordered.select("id", tokenize(F.col("text"), path, end_id).alias("ids"))
    manifest = write_records(coded, folder, width)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def with_start(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all records before, over all shards (one
    manifest row per shard is summed up)."""
    base = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("before"))
