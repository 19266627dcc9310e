"""Two tokenizers' tokens of the same texts aligned by their bytes: groups, links, and how often tokens are linked in the corpus."""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.bitplanes import from_planes, to_planes
from ridgeline.llm.chunks import MIXED, SPACE, Memo, Numbers, WordIds, byte_characters, byte_level_cuts, chunks, parts, sections
from ridgeline.llm.common import staged

BLOCK_PARTS = 1 << 20  # of texts: when a task has so many, it passes on what it has counted
BLOCK_DOCS = 1 << 15
SHIFT = 32  # a pair of ids is one long, the first tokenizer's id in the high bits


def align(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(a from, a to, b from, b to) of each group: two pointers over the cumulative ends of the tokens, a group closes where both end."""
    groups, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        first_a, first_b = i, j
        end_a += size_a[a[i]]
        end_b += size_b[b[j]]
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                end_a += size_a[a[i]]
                i += 1
            else:
                end_b += size_b[b[j]]
                j += 1
        groups.append((first_a, i, first_b, j))
    return groups


class Aligner:
    """Tokens, groups and links of space+text, learnt once a part of a chunk: white space starts a token of either tokenizer, and so
    do marks after letters, so all of these start a group. What the two vocabularies don't show to be so is taken whole."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.lead = [self.b.piece_to_id("▁"), next(i for i, x in enumerate(self.bytes_b) if self.b.is_byte(i) and x == b"\n")]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: A piece has white space in front only, or is white space; then pieces never reach across chunks. Texts with other
        #: white space than that are taken whole.
        own = re.compile(f"▁*[^▁{SPACE}]*|[{SPACE}]", re.DOTALL)
        self.glued = {c for p in plain if not own.fullmatch(p) for c in re.findall(f"[▁{SPACE}]", p)} - {"▁"}
        self.cuts = byte_level_cuts(self.a) and not self.glued & {" ", "\n"} and all(own.fullmatch(p) or self.glued & set(p) for p in plain) and not any(MIXED.search(p) for p in plain)
        self.ids_a = WordIds(self.a)
        #: A byte-level vocabulary with all bytes changes no text.
        self.keeps_a = byte_level_cuts(self.a) and {bytes([k]) for k in range(256)} <= set(self.bytes_a)
        self.parts, self.memo = Memo(parts, 120_000), Memo(lambda part: self.learn(part, self.piece_ids([part])[0]), 220_000)
        self.shown = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def piece_ids(self, new: list[str]) -> list[list[int] | None]:
        """The second tokenizer's ids of parts. It puts a blank before each text, which a part that starts with one has already;
        before others a line end keeps the blank apart, as no piece holds one. So it does for a blank alone, as nothing is put
        before an empty text."""
        led = [x[0] == " " and x != " " for x in new]
        found = self.b.encode([x[1:] if own else "\n" + x for x, own in zip(new, led, strict=True)], num_threads=1)
        return [ids if own else ids[2:] if ids[:2] == self.lead else None for own, ids in zip(led, found, strict=True)]

    def records(self, asked: list[str]) -> list[tuple | None]:
        """What learn has of each; parts that nobody asked for lately are learnt together."""
        memo, elder = self.memo, self.memo.elder
        new = [x for x in asked if x not in memo and x not in elder and len(x) <= memo.LONG]
        if new:
            memo.update(zip(new, map(self.learn, new, self.piece_ids(new)), strict=True))
        return list(map(memo.__getitem__, asked))

    def learn(self, part: str, b: list[int] | None) -> tuple | None:
        """(tokens of either, groups, links, the groups as text, different pairs, how often each if not once) of a part whose ids by
        the second tokenizer are b; None where either side's bytes differ."""
        a, want, shown = self.ids_a(part), part.encode(), self.shown
        if b is None or b"".join(map(self.bytes_b.__getitem__, b)) != want or not (self.keeps_a or b"".join(map(self.bytes_a.__getitem__, a)) == want):
            return None
        keys, text, links, large = [], [], 0, None
        groups = align(a, b, self.size_a, self.size_b)
        for i, k, j, m in groups:
            if k - i == 1 and m - j == 1:
                links += 1
                text.append(f"{shown[a[i]]}|{shown[b[j]]}")
                keys.append(a[i] << SHIFT | b[j])
                continue
            n = (k - i) * (m - j)
            links += n
            one, two = a[i:k], b[j:m]
            text.append(f"{','.join([shown[x] for x in one])}|{','.join([shown[x] for x in two])}")
            if n <= 1024:
                for p in one:
                    p <<= SHIFT
                    keys += [p | q for q in two]
            else:  # ids recur, so their different pairs are fewer
                large, twos = large or Counter(), Counter(two).items()
                for p, n in Counter(one).items():
                    for q, o in twos:
                        large[p << SHIFT | q] += n * o
        often = None
        if large or len(set(keys)) < len(keys):
            counts = Counter(keys)
            counts.update(large or ())
            keys, often = counts, array("q", counts.values()).tobytes()
        return (len(a), len(b), len(groups), links, ";".join(text), array("q", keys).tobytes(), often)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}  # of this Python worker, which serves many tasks


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """The worker's aligner by two tokenizer files; None: the public byte_bpe_50k.json and piece_bpe_32k.model of its machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers in byte planes, compressed."""
    import zstandard

    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(p for x in arrays for p in to_planes(np.ascontiguousarray(x, "<i8"), False)))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(data, "<i8", n, 8).tolist():
        out.append(from_planes([data[at + k * size : at + (k + 1) * size] for k in range(8)], size, "<i8", False))
        at += 8 * size
    return out


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first+1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Some documents of a task: which parts each has, which pairs each part links, how many of the documents hold a pair linked."""

    def __init__(self) -> None:
        self.at = Numbers()
        self.records: list[tuple] = []
        self.texts: list[str] = []
        self.bad: set[int] = set()
        self.docs: list[tuple] = []  # doc_id, digest, different parts, how often each
        self.size = 0  # parts of all documents

    def add(self, aligner: Aligner, doc_id: int | None, text: str | None) -> None:
        digest, found = hashlib.sha256(), []
        cuts = aligner.cuts and not any(c in (text or "") for c in aligner.glued)
        for k, section in enumerate(sections(" " + text) if cuts else [" " + text]) if text else ():
            cut = chain.from_iterable(map(aligner.parts.__getitem__, chunks(section))) if cuts else [section]
            numbers = list(map(self.at.__getitem__, cut))
            for record in aligner.records(self.at.names[len(self.records) :]):
                if record is None:
                    self.bad.add(len(self.records))
                self.records.append(record or (0, 0, 0, 0, "", b"", None))
                self.texts.append(self.records[-1][4])
            if self.bad and not self.bad.isdisjoint(numbers):
                found = []
                break
            digest.update((";" * bool(k) + ";".join(map(self.texts.__getitem__, numbers))).encode())
            found.append(np.array(numbers))
            self.size += len(numbers)
        aligner.parts.turn()
        aligner.memo.turn()
        self.docs.append((doc_id, digest.hexdigest() if found else "", *np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)))

    def row(self, number: int) -> tuple:
        each = np.array([np.fromiter((r[k] for r in self.records), np.int64, len(self.records)) for k in range(4)]).T
        pairs, pair = np.unique(np.frombuffer(b"".join(r[5] for r in self.records), np.int64), return_inverse=True)
        sizes = np.array([len(r[5]) // 8 for r in self.records], np.int64)
        first, often = np.cumsum(sizes) - sizes, np.ones(len(pair), np.int64)
        for k, r in enumerate(self.records):
            if r[6] is not None:
                often[first[k] : first[k] + sizes[k]] = np.frombuffer(r[6], np.int64)
        docs_of, last = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        sums = np.zeros((len(self.docs), 4), np.int64)
        for k, (_, _, part, n) in enumerate(self.docs):
            if len(part):
                held = pair[runs(first[part], sizes[part])]
                place = np.arange(len(held))
                last[held] = place
                docs_of[held[last[held] == place]] += 1  # each pair once
                sums[k] = n @ each[part]
        links = packed(np.array([len(d[2]) for d in self.docs]), *(np.concatenate(x) for x in zip(*((d[2], d[3]) for d in self.docs), strict=True)), sizes, pair, often)
        return (number, [d[0] for d in self.docs], [d[1] for d in self.docs], *sums.T, links, pairs, docs_of)


_ROW = "block long, doc_ids array<long>, digests array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, links binary, pairs array<long>, docs array<long>"


def aligned_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """A row for each block of documents of a task: their own counts and digests, which parts they have (links, see Block),
    and the different pairs with the number of the block's documents that hold each linked."""

    def run(batches):
        tool, block, n = aligner(path_a, path_b), Block(), 0
        part = TaskContext.get().partitionId() << 33

        def batch():
            longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
            types = [pa.int64(), longs, strings, longs, longs, longs, longs, pa.binary(), longs, longs]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.row(part + n), types, strict=True)], [x.split()[0] for x in _ROW.split(", ")])

        gc.disable()  # nothing that is kept is part of a cycle, and looking for some again and again takes a sixth of the time
        try:
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    block.add(tool, doc, text.as_py())
                    if block.size >= block_parts or len(block.docs) >= BLOCK_DOCS:
                        yield batch()
                        block, n = Block(), n + 1
            if block.docs:
                yield batch()
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


def linked_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text).

    Tokens of space+text by a byte-level tokenizer (a) and a piece model (b, which adds the space). Offsets where tokens of both
    end cut them into groups; links are all pairs of an a and a b token of one group. A pair's count is the number of rows of
    docs that hold it linked; n_best: links whose count is the highest of their a id, count_sum: counts of all links. The digest
    is of `a1,a2|b1;a3|b2,b3`. Null and empty texts, and those that either side changes, have zeros and ''.

    Tasks count pairs by blocks of documents, so a frequent pair is a row a block. Blocks get back the counts of their own pairs
    alone; a document's links are sums over its parts, so no table of documents and pairs is ever made. Null and repeated
    doc_ids are kept; no rows give no rows.
    """
    c = F.col
    blocks = staged(aligned_blocks(docs, path_a, path_b, block_parts), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")).select("block", "at", c("x.pairs").alias("pair"), c("x.docs").alias("docs")).where("docs > 0")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", SHIFT))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    known = counts.join(best, "a").select("pair", "count", (c("count") == c("best")).alias("top"))
    back = pairs.join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "top")).alias("x"))  # a block's own pairs
    held = blocks.drop("pairs", "docs").join(back, "block", "left").select(*[x for x in blocks.columns if x not in ("block", "pairs", "docs")], *[c(f"x.{k}").alias(k) for k in ("at", "count", "top")])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(batches):
        for b in batches:
            for k in range(b.num_rows):
                of = {n: b.column(n)[k] for n in b.schema.names}
                ids = {n: of[n].values for n in ("doc_ids", "digests", "n_a", "n_b", "n_groups", "n_links")}
                part_n, part, n, sizes, pair, often = unpacked(of["links"].as_py())
                count, top = (np.zeros(int(pair.max()) + 1 if len(pair) else 0, np.int64) for _ in range(2))
                if of["at"].is_valid:
                    at = of["at"].values.to_numpy()
                    count[at], top[at] = of["count"].values.to_numpy(), of["top"].values.to_numpy(zero_copy_only=False)
                sums = []
                for value in (top, count):
                    per_part = np.diff(np.cumsum(np.append(0, value[pair] * often))[np.cumsum(np.append(0, sizes))])
                    sums.append(np.diff(np.cumsum(np.append(0, per_part[part] * n))[np.cumsum(np.append(0, part_n))]))
                yield pa.RecordBatch.from_arrays([ids["doc_ids"], *(ids[x] for x in names[1:5]), *map(pa.array, sums), ids["digests"]], names)

    return held.mapInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
