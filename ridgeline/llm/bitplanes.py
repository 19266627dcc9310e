"""Token ids in files of bit or byte planes: blocks of ids transposed, each plane compressed with zstandard, found by a chunk index."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.chunks import MARKS, Memo, WordIds, byte_level_cuts, chunks, sections
from ridgeline.llm.common import shared_dir, staged

MAGIC = b"IDPLANES"
END = 0  # the id after each document
BLOCK = 1 << 16  # values of a block
TEXT_BYTES = 1 << 27  # of the texts of a file, about
RUN = 1024  # files whose starts are summed in one group
IDS, DOCS, NAMED, LENGTHS = range(4)  # kinds of chunks: ids; of each document its id, whether it has one, its number of ids
_TYPES = {IDS: "<u4", DOCS: "<i8", NAMED: "u1", LENGTHS: "<i8"}
_ENTRY = struct.Struct("<BBHIQI")  # kind, whether bits, planes, values, place, crc32; the planes' sizes follow
_FOOT = struct.Struct("<QIIQ8s")  # the index's place, size and crc32, all ids, MAGIC


class Corrupt(ValueError):
    """A file that isn't what the writer wrote."""


def to_planes(values: np.ndarray, bits: bool) -> list[bytes]:
    """The block's bytes (or bits) by significance: plane k holds the k-th byte of every value, or the k-th bit."""
    octets = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    if not bits:
        return [x.tobytes() for x in octets]
    return [x.tobytes() for o in octets for x in np.packbits(np.unpackbits(o[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str, bits: bool) -> np.ndarray:
    """The n values of a numpy type whose planes these are."""
    octets = planes
    if bits:
        bit = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        octets = [np.packbits(np.stack(bit[k : k + 8], axis=1), axis=1, bitorder="little").ravel() for k in range(0, len(bit), 8)]
    got = np.empty((n, len(octets)), np.uint8)
    for k, o in enumerate(octets):
        got[:, k] = o if bits else np.frombuffer(o, np.uint8)
    return got.reshape(-1).view(kind)


class Writer:
    """Writes documents one after another; a block is written as soon as it is full, so memory holds a block of each kind and the index."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.bits, self.block = out, bits, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.open: dict[int, list[np.ndarray]] = {k: [] for k in _TYPES}
        self.held = dict.fromkeys(_TYPES, 0)
        self.index, self.place, self.ids = [], len(MAGIC), 0
        out.write(MAGIC)

    def _put(self, kind: int, values: np.ndarray) -> None:
        self.open[kind].append(values)
        self.held[kind] += len(values)
        if self.held[kind] >= self.block:
            every = np.concatenate(self.open[kind])
            whole = len(every) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._write(kind, every[lo : lo + self.block])
            self.open[kind], self.held[kind] = [every[whole:]], len(every) - whole

    def _write(self, kind: int, values: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(np.ascontiguousarray(values), self.bits)]
        data = b"".join(planes)
        self.index.append(_ENTRY.pack(kind, self.bits, len(planes), len(values), self.place, zlib.crc32(data)) + np.array([len(p) for p in planes], "<u4").tobytes())
        self.out.write(data)
        self.place += len(data)

    def add(self, parts: Iterator[np.ndarray]) -> int:
        """Ids of a document, part by part, without the document's own entry; their number."""
        n = 0
        for p in parts:
            self._put(IDS, p.astype("<u4", copy=False))
            n += len(p)
        self.ids += n
        return n

    def end(self, doc_id: int | None, length: int) -> None:
        """The entry of the document whose ids were added."""
        for kind, v in ((DOCS, doc_id or 0), (NAMED, doc_id is not None), (LENGTHS, length)):
            self._put(kind, np.array([v], _TYPES[kind]))

    def close(self) -> None:
        """The blocks that aren't full, the index and the footer."""
        for kind, parts in self.open.items():
            if self.held[kind]:
                self._write(kind, np.concatenate(parts))
        index = self.zstd.compress(b"".join(self.index))
        self.out.write(index)
        self.out.write(_FOOT.pack(self.place, len(index), zlib.crc32(index), self.ids, MAGIC))


class Reader:
    """Reads a file of Writer's; only the chunks that are asked for. Everything read is held against its crc32; Corrupt otherwise."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.seek(0, os.SEEK_END)
        if size is None:
            size = file.tell()
        if size < len(MAGIC) + _FOOT.size:
            raise Corrupt("too short")
        place, length, crc, self.n_ids, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        index = self._at(place, length)
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC or len(index) != length or zlib.crc32(index) != crc:
            raise Corrupt("the index is damaged")
        index, at = self.zstd.decompress(index), 0
        self.chunks: dict[int, list[tuple]] = {k: [] for k in _TYPES}
        while at < len(index):
            kind, bits, planes, n, place, crc = _ENTRY.unpack_from(index, at)
            at += _ENTRY.size
            self.chunks[kind].append((n, place, crc, bits, np.frombuffer(index, "<u4", planes, at)))
            at += 4 * planes
        #: Ids before each chunk of ids, and before the end.
        self.before = np.cumsum([0, *(c[0] for c in self.chunks[IDS])])
        if self.before[-1] != self.n_ids:
            raise Corrupt("chunks are missing")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def values(self, kind: int, k: int) -> np.ndarray:
        """The k-th chunk of a kind."""
        n, place, crc, bits, sizes = self.chunks[kind][k]
        data = self._at(place, int(sizes.sum()))
        if zlib.crc32(data) != crc:
            raise Corrupt("a chunk is damaged")
        edge = np.cumsum([0, *sizes])
        return from_planes([self.zstd.decompress(data[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], n, _TYPES[kind], bool(bits))

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """count ids from start on, chunk by chunk."""
        k = int(np.searchsorted(self.before, start, side="right")) - 1
        while count > 0:
            lo = int(start - self.before[k])
            got = self.values(IDS, k)[lo : lo + count]
            yield got
            start, count, k = start + len(got), count - len(got), k + 1

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(doc_id, start in the file, length, ids part by part) of each document, in order; its ids are to be read before the next."""
        at, chunk, rest = 0, -1, np.empty(0, "<u4")

        def some(n: int) -> Iterator[np.ndarray]:
            nonlocal chunk, rest
            while n:
                if not len(rest):
                    chunk += 1
                    rest = self.values(IDS, chunk)
                got, rest = rest[:n], rest[n:]
                n -= len(got)
                yield got

        for k in range(len(self.chunks[DOCS])):
            for doc, named, n in zip(*(self.values(kind, k).tolist() for kind in (DOCS, NAMED, LENGTHS)), strict=True):
                yield doc if named else None, at, n, some(n)
                at += n


class ByteIds:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library, learnt once a chunk where it takes chunks one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = byte_level_cuts(self.tokenizer)
        self.ids = WordIds(self.tokenizer)
        self.memo = Memo(self.learn, 400_000)

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk, put together where its pattern cuts it: marks after a letter or digit, and one line end before
        something else, are words of their own."""
        body = chunk.rstrip(MARKS)
        if body and body[-1].isalnum():
            if len(body) < len(chunk):
                return self.memo[body] + self.memo[chunk[len(body) :]]
            if chunk[0] == "\n" and len(chunk) > 1 and not chunk[1].isspace():
                return self.memo["\n"] + self.memo[chunk[1:]]
        return array("I", self.ids(chunk)).tobytes()

    def of(self, text: str) -> Iterator[np.ndarray]:
        """The tokenizer's own ids of the text, section by section."""
        if not self.cuts or any(s in text for s in self.special):  # special tokens are found across chunks
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            return
        for part in sections(text):
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, chunks(part))), "<u4")
            self.memo.turn()


_IDS: dict[str, ByteIds] = {}  # of this Python worker, which serves many tasks


def byte_ids(path: str | None) -> ByteIds:
    """The worker's encoder by a tokenizer file; None: the public byte_bpe_50k.json of its machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _IDS:
        _IDS[path] = ByteIds(path)
    return _IDS[path]


def write_ids(docs: DataFrame, path: str | None = None, folder: str | None = None, bits: bool = False, block: int = BLOCK, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Files of the ids of all texts, each followed by END, in ascending doc_id order: (file, part, documents, ids, start).

    The table is the files' manifest, in the order of part; start is the number of ids in all files before. Texts are dealt by
    ranges of doc_id, one range a file, each written by one task into a file of its own name; only files of tasks that ended
    are in the manifest, so a task that is run again leaves at most a file that nobody lists. A null or empty text is END
    alone; null doc_ids come first; rows of one doc_id follow each other by content; no rows give no files. folder: where
    the files go, a path or URI that all machines reach; by default the folder they share.
    """
    spark = docs.sparkSession
    where = f"{folder or shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    store, top = pafs.FileSystem.from_uri(where)
    store.create_dir(top, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // text_bytes))
    order = ["doc_id", "tie", "row"]  # however many rows share an id, they are dealt to several ranges
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        encoder, end = byte_ids(path), np.array([END], "<u4")
        store, out, n = pafs.FileSystem.from_uri(where)[0], None, 0
        name = f"{top}/{uuid.uuid4().hex}.ids"
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if out is None:
                    out = store.open_output_stream(name)
                    to = Writer(out, bits, block)
                to.end(doc, to.add(encoder.of(text.as_py())) + to.add(iter([end])))
                n += 1
        if out is not None:
            to.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((name, pa.string()), (TaskContext.get().partitionId(), pa.int64()), (n, pa.int64()), (to.ids, pa.int64()))], ["file", "part", "documents", "ids"])

    files = staged(dealt.mapInArrow(run, "file string, part long, documents long, ids long"), "ids_manifest")
    run_of = F.floor(F.col("part") / RUN)
    runs = files.groupBy(run_of.alias("run")).agg(F.sum("ids").alias("all")).select("run", (F.sum("all").over(W.orderBy("run")) - F.col("all")).alias("before"))  # a row for 1024 files
    within = F.sum("ids").over(W.partitionBy("run").orderBy("part")) - F.col("ids")
    return files.withColumn("run", run_of).withColumn("within", within).join(runs, "run").select("file", "part", "documents", "ids", (F.col("before") + F.col("within")).alias("start"))


def read_ids(files: DataFrame, folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files of a manifest, read from the files alone.

    start: ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers. Files that are
    missing or damaged are errors. No files give no rows.
    """
    spark = files.sparkSession
    where = folder or shared_dir(spark)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    def run(batches):
        store = pafs.FileSystem.from_uri(where)[0]
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    cols: list[list] = [[] for _ in names]
                    size = 0
                    for doc, start, n, parts in Reader(f).documents():
                        crc, kept = 0, []
                        for p in parts:
                            crc = zlib.crc32(p.tobytes(), crc)
                            if keep_ids:
                                kept.append(p)
                        for c, v in zip(cols, (doc, before + start, n, crc, np.concatenate(kept) if kept else None), strict=False):
                            c.append(v)
                        size += 32 + n * keep_ids
                        if size > 1 << 20:
                            yield batch(cols)
                            cols, size = [[] for _ in names], 0
                    if cols[0]:
                        yield batch(cols)

    n = max(files.count(), 1)
    return files.select("file", "start", "part").repartitionByRange(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)
