"""Where texts may repeat: runs of windows that share an anchor, found by sampling that depends on content alone.

A text is a sequence of symbols (bytes or words), and a window is so many of them in a row. Of the short runs of symbols
in a window, the one of the smallest hash is its anchor, so equal windows have equal anchors at equal places. Neighbouring
windows mostly share an anchor: they are one segment. Only equal segments, and segments that share an anchor but differ,
can hold equal windows; all others are unique, and are never looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import staged, starts

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]  # odd multipliers
_POS = np.uint64((1 << 28) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    return x


def power_hashes(symbols: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... longest symbols, by length; each doubling combines two neighbours."""
    h, n, out = symbols, 1, {1: symbols}
    while n < longest:
        if len(h) <= n:
            h = np.empty(0, np.uint64)
        else:
            h = mixed(h[:-n] * _ODD[n.bit_length() % 7] + h[n:])
        n *= 2
        out[n] = h
    return out


def run_hashes(hashes: dict[int, np.ndarray], at: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """Hashes of runs of any length from least on, each by so many overlapping blocks as cover the longest."""
    block = 1 << (least.bit_length() - 1)
    parts = max(2, -(-int(length.max()) // block)) if len(length) else 2
    out = length.astype(np.uint64) * _ODD[0] + np.uint64(least)
    for i in range(parts):
        out = mixed(out * _ODD[5] + hashes[block][at + i * (length - block) // (parts - 1)])
    return out


def segments(symbols: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, last window) of each segment of texts that lie one after another.

    ends: where each text ends; windows do not cross these. gram: symbols of an anchor, a power of two.
    """
    none = np.empty(0, np.int64)
    if len(symbols) > int(_POS):
        raise ValueError("a text has more than 2**28 - 1 symbols; split it")
    if len(symbols) < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    block = 1 << (window.bit_length() - 1)
    hashes = power_hashes(symbols, block)
    hashes = {n: h for n, h in hashes.items() if n in (gram, block)}
    key = (hashes[gram] & ~_POS) | np.arange(len(hashes[gram]), dtype=np.uint64)
    span, low, size = window - gram + 1, key, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    n = np.diff(np.concatenate([[0], ends]))
    within = np.repeat(ends, n) - np.arange(len(symbols))  # symbols left in the text
    good = np.flatnonzero(within[: len(low)] >= window)
    anchor = (low[good] & _POS).astype(np.int64)
    first = np.flatnonzero(starts(anchor)) if len(good) else none
    last = np.append(first[1:], len(good)) - 1 if len(first) else none
    a, lo, hi = anchor[first], good[first], good[last]
    seg = run_hashes(hashes, lo, hi - lo + window, window)
    return hashes[gram][a], mixed(seg + (a - lo).astype(np.uint64) * _ODD[3]), lo, hi


def document_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with a column key, distinct (key, text)) of docs (doc_id, text and columns of the operator's own).

    key is doc_id where all are different; else numbers that ascend with doc_id (null first) and differ by text, so that rows of
    one doc_id but different texts are told apart, and rows alike in both share a key. Null texts are unlike empty ones.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.limit(1).count() == 0:
        keyed = docs.withColumn("key", F.col("doc_id").cast("long"))
        return keyed, keyed.select("key", "text")
    marked = docs.withColumn("mark", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    pairs = marked.select("doc_id", "mark").distinct().repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    pairs = staged(pairs.withColumn("key", F.monotonically_increasing_id()).toDF("id_", "mark_", "key"), "keys")
    keyed = marked.join(pairs, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_"))).drop("mark", "id_", "mark_")
    return keyed, keyed.select("key", "text").dropDuplicates(["key"])


ROWS = "ah long, sh long, key long, lo int, n int, pkey long, plo int"
_NAMES = ["ah", "sh", "key", "lo", "n", "pkey", "plo"]
_TYPES = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int32]


def _batch(v: dict[str, np.ndarray], *first) -> pa.RecordBatch:
    names, types = (["kind", *_NAMES], [np.int32, *_TYPES]) if first else (_NAMES, _TYPES)
    cols = [np.full(len(v["ah"]), first[0]), *(v[c] for c in _NAMES)] if first else [v[c] for c in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t, copy=False)) for c, t in zip(cols, types, strict=True)], names)


def in_batch_order(ah: np.ndarray, sh: np.ndarray, key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch of documents. Those whose segment an earlier one of the batch already has (plo >= 0: there, in pkey)
    need no comparison any more, and get a random anchor, which spreads a passage that many texts share."""
    order = np.lexsort((lo, key, mixed(ah * _ODD[1] + sh)))
    ah, sh, key, lo, n = ah[order], sh[order], key[order], lo[order], n[order]
    again = ~starts(ah, sh) if len(ah) else np.empty(0, bool)
    pkey, plo = np.where(again, np.roll(key, 1), 0), np.where(again, np.roll(lo, 1), -1)
    ah = np.where(again, mixed(key.astype(np.uint64) * _ODD[4] + lo.astype(np.uint64)), ah)
    return _batch({"ah": ah, "sh": sh, "key": key, "lo": lo, "n": n, "pkey": pkey, "plo": plo})


def texts_in_parts(keys: list[int], texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[list[int], list[bytes]]]:
    """(keys, texts) of about half a megabyte at a time."""
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(i)
        size += len(text)
        if size >= most or i + 1 == len(texts):
            yield [keys[j] for j in part], [texts[j] for j in part]
            part, size = [], 0


def anchored(docs: DataFrame, symbols_of, window: int, gram: int) -> DataFrame:
    """A row per segment of docs (key, text bytes; keys distinct): anchor hash, segment hash, key, first window lo, windows n, and
    where the batch of documents has the segment before (see in_batch_order). symbols_of: a text's symbols, as 64-bit hashes."""

    def run(batches):
        for b in batches:
            cols = []
            for keys, texts in texts_in_parts(b.column("key").to_pylist(), b.column("text").to_pylist()):
                sym = [symbols_of(t) for t in texts]
                size = np.array([len(s) for s in sym], np.int64)
                ends = np.cumsum(size)
                ah, sh, lo, hi = segments(np.concatenate(sym), ends, window, gram)
                doc = np.searchsorted(ends, lo, side="right")
                cols.append((ah, sh, np.array(keys, np.int64)[doc], lo - (ends - size)[doc], hi - lo + 1))
            if cols:
                yield in_batch_order(*(np.concatenate(c) for c in zip(*cols, strict=True)))

    return docs.mapInArrow(run, ROWS)


def single_windows(docs: DataFrame, rows: DataFrame, symbols_of, window: int) -> DataFrame:
    """A row per window of these segments (key, lo, n) of docs, as anchored gives for segments, with two hashes of the window."""
    block = 1 << (window.bit_length() - 1)

    def run(batches):
        for b in batches:
            cols = []
            count, v = lists_of(b.column("rows"))
            ends, at = np.cumsum(count), 0
            for key, text, end in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), ends.tolist(), strict=True):
                sym = symbols_of(text)
                lo, n = v["lo"][at:end].astype(np.int64), v["n"][at:end].astype(np.int64)
                at = end
                lo = np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                size = np.full(len(lo), window)
                h1, h2 = (run_hashes(power_hashes(x, block), lo, size, window) for x in (sym, mixed(sym * _ODD[1] + _ODD[6])))
                cols.append((h1, h2, np.full(len(lo), key), lo, np.ones(len(lo), np.int64)))
            if cols:
                yield in_batch_order(*(np.concatenate(c) for c in zip(*cols, strict=True)))

    return with_lists(docs, rows, ["lo", "n"], "inner").mapInArrow(run, ROWS)


FOUND = f"kind int, {ROWS}"
REPEATED, UNSURE, FIRST, SHARED = 0, 1, 2, 3


def judged(rows: DataFrame, firsts: bool = False, ranges: int | None = None) -> DataFrame:
    """What follows from the hashes alone, by kind: REPEATED segments start earlier (the one before, of smaller key or place, is
    at plo in pkey); UNSURE ones are the first of their kind, but share their anchor with others, so their windows must be
    compared. With firsts, all first ones are FIRST, or SHARED where they would be UNSURE.

    Rows are dealt by anchor (in so many ranges), sorted, and read as a stream: an anchor that many texts share needs no memory.
    """

    def run(batches):
        held, shared = None, False  # the latest row and the first row of its kind; whether that shares its anchor
        for b in batches:
            if not b.num_rows:
                continue
            v = {c: b.column(c).to_numpy(zero_copy_only=False) for c in _NAMES}
            done = v["plo"] >= 0
            if done.any():
                yield _batch({c: v[c][done] for c in _NAMES}, REPEATED)
                v = {c: v[c][~done] for c in _NAMES}
            if not len(v["ah"]):
                continue
            if held is not None:
                v = {c: np.append(held[c], v[c]) for c in _NAMES}
            new = starts(v["ah"], v["sh"])
            late = np.flatnonzero(~new)
            late = late[late >= (0 if held is None else 2)]  # held: the first row of a kind, then its latest
            if len(late):
                yield _batch({c: v[c][late] for c in _NAMES} | {"pkey": v["key"][late - 1], "plo": v["lo"][late - 1]}, REPEATED)
            f = {c: v[c][new] for c in _NAMES}
            same = ~starts(f["ah"])
            same[0] = shared and held is not None
            sure = same | np.append(same[1:], False)
            for kind, at in ((SHARED if firsts else UNSURE, np.flatnonzero(sure[:-1])), *(((FIRST, np.flatnonzero(~sure[:-1])),) if firsts else ())):
                if len(at):
                    yield _batch({c: f[c][at] for c in _NAMES}, kind)
            held, shared = {c: np.append(f[c][-1:], v[c][-1:]) for c in _NAMES}, bool(same[-1])
        if held is not None and (shared or firsts):
            yield _batch({c: x[:1] for c, x in held.items()}, (SHARED if firsts else UNSURE) if shared else FIRST)

    dealt = rows.repartition("ah") if ranges is None else rows.repartition(ranges, "ah")
    return dealt.sortWithinPartitions("ah", "sh", "key", "lo").mapInArrow(run, FOUND)


def lists_of(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(length of each row's list of structs, their fields one row after another); a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    return count, {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type) if not pa.types.is_binary(f.type)} | {f.name: values.field(i).to_pylist() for i, f in enumerate(values.type) if pa.types.is_binary(f.type)}


def union_of_spans(starts_: np.ndarray, ends_: np.ndarray) -> list[tuple[int, int]]:
    """Spans that cover the same places as these, apart and ascending."""
    if not len(starts_):
        return []
    order = np.argsort(starts_, kind="stable")
    s, e = starts_[order], np.maximum.accumulate(ends_[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), e[np.append(at[1:], len(s)) - 1].tolist(), strict=True))


def with_lists(docs: DataFrame, rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """docs (with key) and the list, by document, of its rows; the segments and spans of one text, so no more than it has places."""
    return docs.join(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("rows")), "key", how)


def proven(docs: DataFrame, repeats: DataFrame, window: int, units_of, joined) -> DataFrame:
    """Spans (key, a, b, proof) of what REPEATED rows (key, lo, n, pkey, plo) cover, with the content of the earlier place.

    Each segment points to the one just before it among its equals, so no document is asked for more than it has segments,
    however often a passage recurs. Segments that continue each other at both places are one span. units_of: a text's units
    (bytes or words); joined: the content of some units. who applies the spans compares (see remaining).
    """

    def run(batches):
        for b in batches:
            count, v = lists_of(b.column("rows"))
            doc = np.repeat(np.arange(len(count)), count)
            key, lo, plo = v["to"], v["lo"].astype(np.int64), v["plo"].astype(np.int64)
            end, shift = lo + v["n"] + (window - 1), plo - lo
            order = np.lexsort((lo, shift, key, doc))
            doc, key, lo, end, shift = doc[order], key[order], lo[order], end[order], shift[order]
            new = starts(doc, key, shift)
            new[1:] |= lo[1:] > end[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(new)) - 1
            a, z = lo[at], end[last]
            texts, before, units, proof, size = b.column("text"), -1, None, [], 0
            first = 0
            for i, (d, x, y) in enumerate(zip(doc[at].tolist(), (a + shift[at]).tolist(), (z + shift[at]).tolist(), strict=True)):
                if d != before:
                    units, before = units_of(texts[d].as_py()), d
                proof.append(joined(units[x:y]))
                size += y - x
                if size > 4_000_000 or i + 1 == len(at):
                    part = slice(first, i + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(key[at][part]), pa.array(a[part].astype(np.int32)), pa.array(z[part].astype(np.int32)), pa.array(proof, pa.binary())], ["key", "a", "b", "proof"])
                    first, proof, size = i + 1, [], 0

    asked = repeats.select(F.col("pkey").alias("key"), F.col("key").alias("to"), "lo", "n", "plo")
    return with_lists(docs, asked, ["to", "lo", "n", "plo"], "inner").select("key", "text", "rows").mapInArrow(run, "key long, a int, b int, proof binary")


def checked(units, count: int, at: int, v: dict, joined) -> list[tuple[int, int]]:
    """The union of a document's spans, each compared with its proof, if it has one; unequal content is an error, not a result."""
    a, b, proof = v["a"][at : at + count].astype(np.int64), v["b"][at : at + count].astype(np.int64), v["proof"][at : at + count]
    for x, y, p in zip(a.tolist(), b.tolist(), proof, strict=True):
        if p is not None and joined(units[x:y]) != p:
            raise ValueError("two different passages have equal 128-bit hashes; use another anchor length")
    return union_of_spans(a, b)


def remaining(docs: DataFrame, spans: DataFrame, units_of, joined, rows_of, schema: str, columns: list[str]) -> DataFrame:
    """rows_of(batch, units, spans) of each batch of docs (key, text and these columns) with all spans (key, a, b, proof) of its
    documents, compared and joined, apart and ascending. Documents without spans count too."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            count, v = lists_of(b.column("rows"))
            at, units, cut = 0, [], []
            for text, n in zip(b.column("text").to_pylist(), count.tolist(), strict=True):
                u = units_of(text)
                units.append(u)
                cut.append(checked(u, n, at, v, joined))
                at += n
            yield rows_of(b, units, cut)

    return with_lists(docs, spans, ["a", "b", "proof"], "left").select(*columns, "text", "rows").mapInArrow(run, schema)
