"""Packing tokenised documents into sequences: large items matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import staged, starts

CAPACITY = 2048
END = 0  # the id after each document
ITEMS = 65_536  # items of a length that are numbered in one group, about
TEXTS_AT_ONCE = 1 << 20  # characters whose new words are learnt at once


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by a tokenizer whose ids never span white space.

    Words recur, so their ids are kept by word, in two generations: when the younger is full it becomes the elder, and what
    the elder held and nobody asked for since is dropped. What is new in many texts is learnt at once. A text gives the same
    ids as the tokenizer itself.
    """

    #: The tokenizer's white space ends words, but str.split also cuts at these, for which the tokenizer has ids.
    KEPT = "\x1c\x1d\x1e\x1f"

    #: Letters that lower-case one to one and have no other composed form, and a run of marks after them: two tokenizer words.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
    #: Words by which a tokenizer shows that it takes simple words so.
    PROBES = ("a", "Zug", "ÀÖØÞàöøÿß", "straße,", "word.***", "don'", "x'\"", "L@#", "é_-", "Ðing&&&")

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: By byte, the character that a byte-level model has for it.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.by_parts = self._shows_parts()

    def encode(self, text: str) -> bytes:
        """The tokenizer's own ids of a text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _shows_parts(self) -> bool:
        return all(self._of_model(m[1].lower().translate(self.chars)) + (self._of_model(m[2]) if m[2] else b"") == self.encode(w) for w in self.PROBES if (m := self.SIMPLE.fullmatch(w)))

    def _learn(self, new: list[str]) -> None:
        """New words' ids: simple words, if the tokenizer takes them so, by its model from their letters and marks; others by all of it."""
        whole = new
        if self.by_parts:
            whole, marks, tokenize, chars, match = [], self.marks, self.tokenizer.model.tokenize, self.chars, self.SIMPLE.fullmatch
            letters: dict[str, bytes] = {}
            for w in new:
                m = match(w)
                if m is None:
                    whole.append(w)
                    continue
                body, end = m[1].lower(), m[2]
                ids = letters.get(body)
                if ids is None:
                    ids = letters[body] = array("I", [t.id for t in tokenize(body if body.isascii() else body.translate(chars))]).tobytes()
                if end:
                    if end not in marks:
                        if len(marks) >= 10_000:
                            marks.clear()
                        marks[end] = self._of_model(end)
                    ids += marks[end]
                self.words[w] = ids
        for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.words[w] = array("I", e.ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [None if any(c in t for c in self.KEPT) or any(s in t for s in self.special) else t.split() for t in texts]  # special tokens are found across words
        asked = set().union(*(words for words in split if words))
        missing = asked - self.words.keys()
        if len(self.words) + len(missing) > self.most:
            self.elder, self.words = self.words, {}
            missing = asked
        known = missing & self.elder.keys()
        self.words.update(zip(known, map(self.elder.__getitem__, known), strict=True))
        self._learn(list(missing - known))
        ids_of = self.words.__getitem__
        return [self.encode(t) if words is None else b"".join(map(ids_of, words)) for t, words in zip(texts, split, strict=True)]


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker, which serves many tasks


def encoder_of(path: str | None) -> Encoder:
    """The worker's encoder by a tokenizer file; None: the public word_bpe_49k.json of its machine."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of each document's pieces: its ids and then END, cut only if longer than capacity.

    path: the tokenizer's file, None for the public word_bpe_49k.json of each machine. A null or empty text gives one
    piece of END alone; a null doc_id is kept; row tells repeated rows apart; no rows give no pieces.
    """

    def run(batches):
        encoder = encoder_of(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            rows, ids_of, texts = b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")
            at = 0
            while at < b.num_rows:
                part, size = [], 0
                while at + len(part) < b.num_rows and size < TEXTS_AT_ONCE:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                cols: list[list] = [[], [], [], [], [], [], []]
                for k, ids in enumerate(encoder.encode_all(part)):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[lo : lo + 4 * capacity]
                        for c, v in zip(cols, (rows[at + k], ids_of[at + k], piece, lo // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<i4") if keep_ids else None), strict=True):
                            c.append(v)
                at += len(part)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 7 if keep_ids else 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds[: len(names)], strict=False)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How to pack so many items of each length: (lengths in a bin, number of such bins).

    Items above a third of the capacity share a bin with at most one of their kind: from the longest down, each is matched
    with the longest that still fits. Smaller items, from the longest down, go to the smallest gap that holds them; equal
    bins are handled together, so the work depends on the lengths, not on the items.
    """
    left = {n: c for n, c in counts.items() if c}
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(content: tuple[int, ...], n: int) -> None:
        at = bins[capacity - sum(content)]
        at[content] = at.get(content, 0) + n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            put((n,), left[n])
            large.pop()
            left[n] = 0
            continue
        m = large[k]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        if pairs:
            put((n, m), pairs)
            left[n] -= pairs
            left[m] -= pairs
        elif m == n:  # one of them is left
            if k:
                m = large[k - 1]
                put((n, m), 1)
                left[m] -= 1
            else:
                put((n,), 1)
            left[n] = 0
        large = [x for x in large if left[x]] if not left[n] or not left[m] else large
    gaps = sorted(g for g in bins if bins[g])
    for n in sorted((n for n in left if left[n]), reverse=True):
        todo = left[n]
        while todo:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                whole, rest = divmod(todo, each)
                fresh = ([((n,) * each, whole)] if whole else []) + ([((n,) * rest, 1)] if rest else [])
                todo = 0
            else:
                gap = gaps[k]
                content, have = bins[gap].popitem()
                each = gap // n
                use = min(have, -(-todo // each))
                whole, rest = (use, 0) if use * each <= todo else (use - 1, todo - (use - 1) * each)
                fresh = [(content + (n,) * each, whole)] * bool(whole) + [(content + (n,) * rest, 1)] * bool(rest)
                if have > use:
                    bins[gap][content] = have - use
                todo -= whole * each + rest
                if not bins[gap]:
                    del gaps[k]
            for content, number in fresh:
                gap = capacity - sum(content)
                if gap not in gaps:
                    bisect.insort(gaps, gap)
                put(content, number)
    return [(content, n) for at in bins.values() for content, n in at.items()]


def pack(pieces: DataFrame, capacity: int = CAPACITY, planner: Callable = pack_counts) -> DataFrame:
    """pieces (with length from 1 to capacity) and the sequence_id and offset of each; sequences are as few as the planner finds.

    A piece as long as the capacity is a sequence by itself, with a negative id. Of the others only counts reach the driver,
    by length and hash group, which plans the bins. Each item of a length has a number among its like, from the counts of
    its groups and a place within its group, so that a frequent length isn't numbered by one task: groups hold about ITEMS
    items, and are more the more items there are. The plan goes to the items as a table by length and group: the n-th item
    of a length goes to the n-th place that the plan has for the length.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    sizes = rest.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    groups = spark.createDataFrame([(r["length"], -(-r["n"] // ITEMS)) for r in sizes], "length long, groups long")
    spread = rest.join(F.broadcast(groups), "length").withColumn("group", F.expr("cast(pmod(xxhash64(row, piece), groups) as int)")).drop("groups")
    per = spread.groupBy("length", "group").agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {r["length"]: r["n"] for r in sizes}
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first item, its sequence, offset
    used: dict[int, int] = defaultdict(int)
    first = 0
    for content, n in sorted(planner(counts, capacity), reverse=True):
        offset = 0
        for x in content:
            slots[x].append((used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    table, before = [], defaultdict(int)
    for r in sorted(per):
        length, lo = r["length"], before[r["length"]]
        before[length] = hi = lo + r["n"]
        all_ = slots[length]
        a, b = bisect.bisect_right(all_, (lo, float("inf"), 0)) - 1, bisect.bisect_left(all_, (hi, -1, 0))
        table.append((length, r["group"], lo, [x[0] for x in all_[a:b]], [x[1] - x[0] for x in all_[a:b]], [x[2] for x in all_[a:b]]))
    plan = spark.createDataFrame(table, "length long, group int, before long, items array<long>, shifts array<long>, offsets array<long>")
    placed = spread.withColumn("at", F.row_number().over(W.partitionBy("length", "group").orderBy("row", "piece")) - 1)
    numbered = placed.select(*[f"`{n}`" for n in names], "group", "at")

    def place(batches):
        by: dict[tuple, tuple] = {}
        for b in batches:
            length, group, at = (b.column(c).to_numpy() for c in ("length", "group", "at"))
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            new = starts(length, group)
            edge = np.append(np.flatnonzero(new), len(at))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                name = (int(length[lo]), int(group[lo]))
                if name not in by:  # rows of a group follow each other
                    by = {name: (b.column("before")[lo].as_py(), *(np.array(b.column(c)[lo].as_py(), np.int64) for c in ("items", "shifts", "offsets")))}
                before_, item, shift, offset = by[name]
                n = at[lo:hi] + before_
                k = np.searchsorted(item, n, side="right") - 1
                seq[lo:hi], off[lo:hi] = shift[k] + n, offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    last = F.col("at") == 0  # the plan of a group travels with its first item only
    held = numbered.join(plan, ["length", "group"])
    for c in ("items", "shifts", "offsets"):
        held = held.withColumn(c, F.when(last, F.col(c)))
    held = held.sortWithinPartitions("length", "group", "at")
    return held.mapInArrow(place, f"{fields}, sequence_id long, offset long").unionByName(full)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Each piece of each row of docs (doc_id, text), with its sequence and offset; see tokenised_pieces and pack.

    Repeated rows are packed again; a null doc_id is kept as null; no rows give no rows."""
    return pack(staged(tokenised_pieces(docs, path, capacity, keep_ids), "pieces"), capacity).drop("row")
