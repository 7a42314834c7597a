"""Token ids in byte-aligned variable-length shards (operator 6).

``encode`` range-partitions the documents by id, tokenizes every whole text and writes blocks of
token ids; ``decode`` reads blocks back.  A block holds about ``block_tokens`` ids of consecutive
documents (ascending id) and is one row of the shard files, which Spark's own writer commits, so a
lost executor leaves no half-written shard:

* ``table``    ids of the block by falling frequency, ties by id: uint32, little endian;
* ``control``  two bits an id, four ids a byte, lowest bits first: bytes that its rank takes, less one;
* ``data``     the ranks, little endian, 1 to 4 bytes each, without gaps;
* ``doc_ids``, ``lengths``  int64 and uint32 of each document, with ``nulls`` for null ids;
* ``shard``, ``block``, ``first``  place in the order, and ids before the block in its shard.

Ranks are per block, so writing needs a single pass over the texts and no statistics of the whole.

Definedness: a null or empty text yields the end id alone; repeated ids keep one entry a row (ordered
by text); null ids come first; a very long text is encoded whole and may be a block of its own; an empty table
gives no blocks; other columns are ignored, whatever their names.

The tokenizer's own merges see each distinct *chunk* once a worker: texts are cut only where its
pre-tokenizer always cuts (before a single space, between ASCII letters and punctuation, around a
single line feed), chunks are hashed with numpy, and the library encodes the chunks that the
worker's bounded cache lacks.  Texts with a special token's string are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curio.llm import common

BLOCK_SCHEMA = "shard int, block int, first long, n_tokens long, n_docs int, table binary, control binary, data binary, doc_ids binary, nulls binary, lengths binary"
END_ID = 0
_VALUES = common.byte_values(6_007, fold_case=False)


def _classes() -> np.ndarray:
    """For each byte, its classes as bits."""
    byte = np.arange(256)
    space = np.isin(byte, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
    letter = ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
    digit = (byte >= 48) & (byte <= 57)
    # white space beyond ASCII is C2 xx or E1-E3 xx xx in UTF-8
    flags = [space, letter, (byte > 0x20) & (byte < 0x7F) & ~letter & ~digit & (byte != 0x27), (byte > 0x20) & (byte < 0x7F), byte == 0xC2, (byte >= 0xE1) & (byte <= 0xE3), byte == 0x20, byte == 0x0A]
    return sum(f.astype(np.uint8) << np.uint8(k) for k, f in enumerate(flags)).astype(np.uint8)


_SPACE, _LETTER, _PUNCT, _SOLID, _ODD2, _ODD3, _BLANK, _LINE = (np.uint8(1 << k) for k in range(8))
_CLASS = _classes()


def chunk_starts(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks of the texts begin, from their bytes' classes; every start is a cut of a GPT-2 style pre-tokenizer."""
    n = len(classes)
    if not n:
        return np.empty(0, np.int64)
    cut = np.zeros(n, bool)
    # a blank alone between others than white space
    i = np.flatnonzero(classes & (_BLANK | _PUNCT | _LINE))
    i = i[(i > 0) & (i < n - 1)]
    here, prev = classes[i], classes[i - 1]
    blank = i[(here & _BLANK != 0) & (prev & _SPACE == 0) & (classes[i + 1] & (_SPACE | _ODD2 | _ODD3) == 0)]
    blank = blank[((classes[blank - 2] & _ODD2) == 0) & ((classes[blank - 3] & _ODD3) == 0)]
    cut[blank] = True
    cut[i[((here & _PUNCT != 0) & (prev & _LETTER != 0)) | ((here & _LINE != 0) & (prev & _SOLID != 0))]] = True
    line = i[(here & _LINE != 0) & (prev & _SOLID != 0) & (classes[i + 1] & _LETTER != 0)]
    first = np.zeros(n + 1, bool)
    first[at] = True
    line = line[~first[line]]  # the byte before belongs to the same text
    cut[line + 1] = True
    last = at[1:] - 1
    cut[last[(last >= 0) & (classes[last] & _BLANK != 0)]] = False  # a blank at the end has nothing after it
    if classes[-1] & (_PUNCT | _LINE) and n > 1:
        cut[-1] = bool(((classes[-1] & _PUNCT) and (classes[-2] & _LETTER)) or ((classes[-1] & _LINE) and (classes[-2] & _SOLID)))
    cut |= first[:n]
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Token ids of texts, through a bounded cache of the ids of chunks."""

    def __init__(self, tokenizer_path: str, max_chunks: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.max_chunks = max_chunks
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.empty(1 << 15, np.uint64)
        self.pos = np.empty(1 << 15, np.int64)
        self.size = np.empty(1 << 15, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.known = self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for none: open addressing, all hashes at once."""
        mask = np.uint64(len(self.slots) - 1)
        slot = hashes & mask
        entry = self.slots[slot]
        open_ = np.flatnonzero((entry >= 0) & (self.keys[entry] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
            entry[open_] = self.slots[slot[open_]]
            open_ = open_[(entry[open_] >= 0) & (self.keys[entry[open_]] != hashes[open_])]
        return entry

    def _place(self, entries: np.ndarray) -> None:
        mask = np.uint64(len(self.slots) - 1)
        slot = self.keys[entries] & mask
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + np.uint64(1)) & mask

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate((array, np.empty(max(n - len(array), len(array)), array.dtype)))

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, lengths) of chunks.  Simple chunks are encoded many at a time, joined by line feeds."""
        ids_of, sizes = [], []
        size = ends - starts
        for k in range(0, len(starts), 4_000):
            a, n = starts[k : k + 4_000], size[k : k + 4_000]
            text = np.full(int(n.sum()) + len(n), 0x0A, np.uint8)
            to = np.cumsum(n + 1) - n - 1
            text[common.ranges(to, n)] = data[common.ranges(a, n)]
            ids = cuts = None
            if simple and len(self.line) == 1:
                ids = np.array(self._plain([text[:-1].tobytes().decode()])[0], np.uint32)
                cuts = np.flatnonzero(ids == self.line[0])
            if cuts is None or len(cuts) != len(n) - 1:
                raw = text.tobytes()
                rows = self._plain([raw[x : x + y].decode() for x, y in zip(to.tolist(), n.tolist(), strict=True)])
                ids_of += [np.array(r, np.uint32) for r in rows]
                sizes += [np.array([len(r) for r in rows])]
                continue
            keep = np.ones(len(ids), bool)
            keep[cuts] = False
            ids_of.append(ids[keep])
            sizes.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
        return np.concatenate(ids_of), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> None:
        for of in (simple, ~simple):
            if not of.any():
                continue
            ids, size = self._encode(data, starts[of], ends[of], bool(simple[of][0]))
            n = int(of.sum())
            self.ids = self._room(self.ids, self.used + len(ids))
            self.keys, self.pos, self.size = (self._room(x, self.known + n) for x in (self.keys, self.pos, self.size))
            new = np.arange(self.known, self.known + n, dtype=np.int32)
            self.ids[self.used : self.used + len(ids)] = ids
            self.keys[new], self.pos[new], self.size[new] = hashes[of], self.used + np.cumsum(size) - size, size
            self.used += len(ids)
            self.known += n
            if 2 * self.known > len(self.slots):
                size_ = len(self.slots)
                while 2 * self.known > size_:
                    size_ *= 4
                self.slots = np.full(size_, -1, np.int32)
                new = np.arange(self.known, dtype=np.int32)
            self._place(new)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n+1 offsets) of the rows' texts, each followed by the end id."""
        raw = data.tobytes() if self.special else b""
        if any(s.encode() in raw for s in self.special):
            rows = self._plain([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
            sizes = np.array([len(r) + 1 for r in rows], np.int64)
            return np.concatenate([np.array([*r, END_ID], np.uint32) for r in rows]), np.concatenate(([0], np.cumsum(sizes)))
        classes = _CLASS[data]
        starts = chunk_starts(classes, at)
        ends = np.concatenate((starts[1:], [len(data)])).astype(np.int64) if len(starts) else starts
        hashes = common.span_hash(common.prefix_hash(data, _VALUES), starts, ends)
        entry = self._find(hashes)
        lacking = np.flatnonzero(entry < 0)
        if len(lacking):
            new, one = np.unique(hashes[lacking], return_index=True)
            one = lacking[one]
            if self.known + len(new) > self.max_chunks:
                self.clear()
                new, one = np.unique(hashes, return_index=True)
            a, b = starts[one], ends[one]
            begin = a + (classes[a] & _BLANK != 0)
            odd = np.concatenate(([0], np.cumsum(classes & (_SPACE | _ODD2 | _ODD3) != 0)))
            self._learn(new, data, a, b, (odd[b] == odd[begin]) & (b > begin))
            entry = self._find(hashes)
        pos, size = self.pos[entry], self.size[entry].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, at)]
        offsets = total + np.arange(len(at))
        out = np.full(int(offsets[-1]), END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = self.ids[common.ranges(pos, size)]
        return out, offsets


def _encoder(path: str) -> ChunkEncoder:
    """One a worker process."""
    cache = common.process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = ChunkEncoder(path)
    return cache["encoder", path]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, control, data) of a block's ids."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    order = np.lexsort((distinct, -counts[distinct]))
    rank = np.zeros(len(counts), np.uint32)
    rank[distinct[order]] = np.arange(len(order), dtype=np.uint32)
    values = rank[ids]
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    four = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = four[np.arange(4) <= extra[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


#: For each control byte, the bytes that its four ids take.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
    rank = raw[start]
    for k in (1, 2, 3):
        if (more := size > k).any():
            rank[more] |= raw[start[more] + k] << np.uint32(8 * k)
    return np.frombuffer(table, "<u4")[rank]


def encode(docs: DataFrame, path: str, tokenizer_path: str, parts: int | None = None, block_tokens: int = 1_000_000) -> None:
    """Write the shard files of ``docs`` (doc_id, text) to the folder ``path``, in ascending doc_id order."""
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        first, number, waiting = 0, 0, 0

        def block() -> pa.RecordBatch:
            ids, sizes, docs_, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            table, control, data = pack(ids)
            row = [shard, number, first, len(ids), len(sizes), table, control, data, docs_.astype("<i8").tobytes(), nulls.tobytes(), sizes.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCK_SCHEMA.split(", ")]
        for rows, data, at in common.slices(batches):
            ids, offsets = encoder(data, at)
            doc = rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())
            held.append((ids, np.diff(offsets), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)))
            waiting += len(ids)
            if waiting >= block_tokens:
                yield block()
                first, number, waiting, held = first + waiting, number + 1, 0, []
        if held:
            yield block()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts or common.shuffle_parts(spark), F.col("doc_id").asc_nulls_first())
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a shard folder, with ``start``: the ids of all blocks before."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row a shard, so the running total is over as many rows as there are shards
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return blocks.join(before, "shard").withColumn("start", F.col("before") + F.col("first"))


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a shard folder: doc_id, start, n_tokens and ids (array of int, with the end id)."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`decode`, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _decoded(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["table"], r["control"], r["data"], r["n_tokens"])
                size = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                begin = np.cumsum(size) - size
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["nulls"], bool))
                arrays = [doc, pa.array(r["start"] + begin), pa.array(size), last(np.split(ids, begin[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read_blocks(spark, path).drop("shard", "block", "first", "before", "n_docs").mapInArrow(rows, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark, "token-shards")
    encode(common.read(spark, sf_dir, "documents"), path, default_tokenizer())
    return digests(spark, path)
