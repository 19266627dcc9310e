"""Repeated byte strings, found by sampled anchors and external induced sorting of what they leave open."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridgeline.llm import anchors
from ridgeline.llm.anchors import REPEATED, UNSURE, lists_of
from ridgeline.llm.common import arrow_map, sealed, shared_dir, staged, starts, utf8
from ridgeline.llm.induced import MOST, Folder, Sequence, repeated_windows

LENGTH, GRAM = 100, 32
TIERS = 8  # stretches around an anchor, of which equal windows share one
SHARD = 1 << 21  # bytes of segments that are sorted as one text, about
HOT = 2048  # different segments of an anchor, beyond which windows are dealt by their own content


def byte_hashes(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


_TABLE = np.random.default_rng(17).integers(0, 2**64, 256, np.uint64)


def anchor_places(data: np.ndarray, edge: np.ndarray, ah: np.ndarray, n: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where each segment (data[edge[i] : edge[i + 1]], of n windows) has its anchor: the first place that all of its windows cover."""
    hashes = anchors.power_hashes(_TABLE[data], gram)[gram].view(np.int64)
    size = length - gram - n + 2  # places that all windows cover
    of = np.repeat(np.arange(len(n)), size)
    at = np.repeat(edge[:-1] + n - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    hit = np.flatnonzero(hashes[at] == ah[of])
    first = hit[np.flatnonzero(np.diff(of[hit], prepend=-1))]
    out = np.full(len(n), -1)
    out[of[first]] = at[first] - edge[of[first]]
    return out


def stretches(data: np.ndarray, edge: np.ndarray, ah: np.ndarray, n: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each segment, TIERS numbers that tell stretches around its anchor apart by their bytes (of the first kind those with the
    most to the anchor's right); 0 where the segment ends before.

    A window reaches length - gram bytes beyond its anchor, some of them on the left. Tier by tier these are at least so many on the left and
    so many on the right, so two equal windows have equal stretches of one tier.
    """
    rest, bytes_ = length - gram, data.tobytes()
    cut = [-(-rest * k // TIERS) for k in range(TIERS + 1)]
    out = np.zeros((len(n), TIERS), np.int64)
    for i, (x, lo, hi, h) in enumerate(zip((edge[:-1] + anchor_places(data, edge, ah, n, length, gram)).tolist(), edge[:-1].tolist(), edge[1:].tolist(), ah.tolist(), strict=True)):
        for k in range(TIERS):
            a, b = x - cut[k], x + gram + rest - cut[k + 1]
            if x < lo:
                out[i] = 1  # no anchor is known: it stays, as do all of this kind
            elif a >= lo and b <= hi:
                out[i, k] = hash((h, bytes_[a:b])) | 1 << 62
    return out


def repeated_spans(docs: DataFrame, unsure: DataFrame, length: int, most: int = MOST, gram: int = GRAM) -> DataFrame:
    """Spans (key, a, b) of bytes covered by strings of UNSURE segments (key, ah, lo, n) that start again.

    A segment's bytes go to the shard of its anchor, where equal strings must meet; there are as many shards as hold about SHARD
    bytes each. A segment that shares no stretch around its anchor with another one has no equal string (see stretches), and
    is left out. Of the others each shard is one text in a file, and its suffixes are sorted by external induction with their common prefixes, with so many tuples in memory at most. The files
    lie in the shared folder, if that is one that tasks can open as files, and go when the task ends.
    """
    shared = shared_dir(docs.sparkSession).removeprefix("file://")

    def cut(batches):
        for b in batches:
            count, v = lists_of(b.column("rows"))
            at, bytes_ = 0, []
            for text, n in zip(b.column("text").to_pylist(), count.tolist(), strict=True):
                bytes_ += [text[x : x + m + length - 1] for x, m in zip(v["lo"][at : at + n].tolist(), v["n"][at : at + n].tolist(), strict=True)]
                at += n
            if bytes_:
                keys = np.repeat(b.column("key").to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(v["ah"]), pa.array(keys), pa.array(v["lo"]), pa.array(v["n"]), pa.array(bytes_, pa.binary())], ["ah", "key", "lo", "n", "bytes"])

    def sort(batches):
        with tempfile.TemporaryDirectory(dir=shared if shared.startswith("/") and os.path.isdir(shared) else None) as name:
            folder = Folder(name)
            held, ends, tiers, segs = Sequence(folder, np.uint8), [np.zeros(1, np.int64)], [], []
            for b in batches:
                column = b.column("bytes")
                edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
                if not len(column):
                    continue
                ah, key, lo, n = (b.column(c).to_numpy() for c in ("ah", "key", "lo", "n"))
                tiers.append(stretches(data, edge - edge[0], ah, n.astype(np.int64), length, gram))
                ends.append(held.n + edge[1:] - edge[0])
                held.append(data)
                segs.append((key, lo, n))
            if not segs:
                return
            held, ends, tiers = held.array(), np.concatenate(ends), np.concatenate(tiers)
            key, lo, n = (np.concatenate(x) for x in zip(*segs, strict=True))
            met = np.zeros(len(key), bool)
            for k in range(TIERS):
                _, of, times = np.unique(tiers[:, k], return_inverse=True, return_counts=True)
                met |= (tiers[:, k] == 1) | ((times[of] > 1) & (tiers[:, k] != 0))
            met = np.flatnonzero(met)
            text, keys, los, ns, start = (Sequence(folder, t) for t in (np.uint16, np.int64, np.int32, np.int32, np.int64))
            for at in range(0, len(met), 1 << 12):
                seg = met[at : at + (1 << 12)]
                size = ends[seg + 1] - ends[seg]
                data = held[np.repeat(ends[seg] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                symbols = np.ones(len(data) + len(size), np.uint16)  # a 1 after each segment
                symbols[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.uint16) + 2
                start.append(text.n + np.cumsum(size + 1) - (size + 1))
                text.append(symbols)
                for s, x in ((keys, key), (los, lo), (ns, n)):
                    s.append(x[seg])
            if not keys.n:
                return
            text.append(np.zeros(65, np.uint16))
            keys, los, ns, start = keys.array(), los.array(), ns.array(), start.array()
            again = repeated_windows(text.array()[:-64], start, ns, length, folder, most)
            for at in range(0, len(again), 1 << 20):
                pos = at + np.flatnonzero(again[at : at + (1 << 20)])
                if not len(pos):
                    continue
                seg = np.searchsorted(start, pos, side="right") - 1
                place = los[seg] + pos - start[seg]
                new = starts(seg) | np.append(True, np.diff(place) > 1)
                edge = np.append(np.flatnonzero(new), len(pos))
                yield pa.RecordBatch.from_arrays([pa.array(keys[seg[edge[:-1]]]), pa.array(place[edge[:-1]].astype(np.int32)), pa.array((place[edge[1:] - 1] + length).astype(np.int32))], ["key", "a", "b"])

    segments = anchors.with_lists(docs, unsure, ["ah", "lo", "n"], "inner").select("key", "text", "rows").mapInArrow(cut, "ah long, key long, lo int, n int, bytes binary")
    total = unsure.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    return segments.repartition(max(1, -(-total // SHARD)), "ah").sortWithinPartitions("key", "lo").mapInArrow(sort, "key long, a int, b int")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All spans (key, a, b, proof) of docs (distinct key, text) that strings of so many bytes cover which also start earlier.

    Segments that share their anchor with different ones are sorted. An anchor with more than hot such segments is a phrase
    that very many texts share: its windows are compared one by one instead, dealt by their own content, so no shard grows
    with it. Segments equal by hash are repeats, and go with the earlier content as proof.
    """
    found = staged(anchors.judged(anchors.anchored(docs, byte_hashes, length, gram)), "found")
    unsure = found.where(F.col("kind") == UNSURE).select("key", "ah", "lo", "n")
    repeats = found.where(F.col("kind") == REPEATED)
    frequent = staged(unsure.groupBy("ah").count().where(F.col("count") > hot).select("ah"), "frequent")
    if frequent.limit(1).count():
        windows = anchors.single_windows(docs, unsure.join(frequent, "ah", "left_semi"), byte_hashes, length)
        repeats = repeats.unionByName(staged(anchors.judged(windows), "windows").where(F.col("kind") == REPEATED))
        unsure = unsure.join(frequent, "ah", "left_anti")
    sorted_ = staged(repeated_spans(docs, unsure, length, gram=gram), "spans")
    return sorted_.withColumn("proof", F.lit(None).cast("binary")).unionByName(anchors.proven(docs, repeats, length, bytes, bytes))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of docs (doc_id, text).

    A byte of the UTF-8 text is removed if a string of so many bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in the same document. Strings are those of the input, within one document. kept: the other bytes. Null and
    short texts lose nothing. Rows alike in doc_id and text are one document and get equal results; rows of one doc_id but
    different texts count as one after another; a null doc_id comes first. No rows give no rows.
    """
    keyed, texts = anchors.document_keys(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")))

    def rows_of(batch, texts_, cut):
        cols: list[list] = [[], [], [], [], []]
        for text, spans_ in zip(texts_, cut, strict=True):
            kept, at = [], 0
            for a, b in spans_:
                kept.append(text[at:a])
                at = b
            joined = b"".join([*kept, text[at:]])
            for c, v in zip(cols, (len(text), len(text) - len(joined), len(spans_), hashlib.sha256(joined).hexdigest(), joined), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return anchors.remaining(keyed, spans(texts, length, gram), bytes, bytes, rows_of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", ["doc_id"])


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The span of the characters that lie wholly in a span of bytes; empty (a, a) if none does."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, max(a, b)


def cut_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs, columns as they are, without the bytes of their texts that without_repeats removes; a character goes if all its
    bytes do, and n_chars, if there, is counted anew. No row goes, and null texts stay null."""
    keyed, texts = anchors.document_keys(sealed(docs, "doc_id", "text"))
    bytes_ = texts.select("key", utf8().alias("text"))
    found = anchors.with_lists(keyed, spans(bytes_, length, gram), ["a", "b", "proof"], "left").select("row", utf8().alias("bytes"), "rows")
    schema = StructType([*found.select("row").schema.fields, StructField("new", StringType())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, v = lists_of(batch.column("rows"))
        at, out = 0, []
        for text, n in zip(batch.column("bytes").to_pylist(), count.tolist(), strict=True):
            kept, done = [], 0
            for a, b in anchors.checked(text, n, at, v, bytes):
                a, b = whole_characters(text, a, b)
                kept.append(text[done:a])
                done = b
            out.append(b"".join([*kept, text[done:]]).decode() if n else None)
            at += n
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "new"])

    found = arrow_map(found, cut, schema)
    changed = F.col("new").isNotNull() & F.col("row.text").isNotNull()
    made = {"text": F.when(changed, F.col("new")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("new")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
