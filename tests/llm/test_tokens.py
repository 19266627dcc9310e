"""Spelling variants, planes of token ids and aligned tokens against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import alignment, bitplanes, catalog, chunks, variants

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, word string, n long, pairs string, `a.b` string, start long"
ODD_TEXTS = [None, "", " ", "\n", "  two  blanks \n\t tab\r\nend ", "<|endoftext|> in <|endoftext|>text", "nul\0 and \x1c\x1d\x1f marks", "▁ piece blank ▁▁", "naïve café — “quotes” … 日本語テキスト \U0001f600\U0001f600", "a<0x41>b </s> <s>", "x\xa0y　z \xa0  w", "code();\r\n  if x {\r\n}\r\nend.\rmore", "a" * 3000, "word " * 500 + "\n" * 50, "é" * 400]


def table(spark, texts, ids=None):
    rows = [(i, t, "word", 3, "p", "z", 9) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sf_texts(spark, name="sf0.001"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents table, odd texts, repeated rows and repeated and null ids."""
    rows = sf_texts(spark)
    extra = [*((10_000 + i, t) for i, t in enumerate(ODD_TEXTS)), rows[3], rows[3], (rows[4][0], "other text of a repeated id"), (None, "no id"), (None, None), (None, "no id")]
    return table(spark, [t for _, t in rows + extra], [i for i, _ in rows + extra]).cache()


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Chunks


@pytest.mark.parametrize("text", [t for t in ODD_TEXTS if t])
def test_chunks_join_to_the_text_and_cut_before_white_space_only(text):
    assert "".join(chunks.chunks(text)) == text == "".join(chunks.sections(text, 7))
    assert all(c and not re.search(f"[^{chunks.SPACE}][{chunks.SPACE}]", c) for c in chunks.CHUNK.findall(text))
    assert all(re.match(f"[{chunks.SPACE}]", c) for c in chunks.chunks(text)[1:])


def test_parts_join_to_the_chunk():
    assert [chunks.parts(c) for c in (" word", "Word,", "\nWord.***", " d'or", " été:", "  x", "4.0")] == [(" word",), ("Word", ","), ("\n", "Word", ".***"), (" d'or",), (" été", ":"), ("  x",), ("4.0",)]


def test_memo_forgets_by_generations_and_learns_once():
    learnt = []
    memo = chunks.Memo(lambda x: learnt.append(x) or x.upper(), most=2)
    for asked in ("ab", "ac", "d", "a", "abcde", "a" * 200, "a" * 200):
        assert [memo[x] for x in asked.split("-")] == [asked.upper()]
        assert memo[asked[:1]] == asked[:1].upper()
        memo.turn()
    assert learnt.count("a") == 1 and learnt.count("a" * 200) == 2 and len(memo) <= 2


# Spelling variants


def plain_words(docs, drop=199, length=6, count=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= count}


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n: dict[str, int], ratio=5):
    near = {w: sorted((-n[v], v) for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)) for w in n}
    form = {w: near[w][0][1] if near[w] and n[near[w][0][1]] >= ratio * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_planted_words(spark):
    n = {"absolute": 1000, "absolut": 150, "absolutes": 900, "abslute": 100, "abslut": 20, "absoluta": 3, "bsolut": 4, "aabbcc": 10, "aabbc": 50, "abbcc": 50, "aabcc": 2, "êtremot": 6, "êtrêmot": 60, "𐐷𐐷zzzz": 5, "𐐷zzzz": 25, "lonely": 7, "s": 3, "t": 20}
    words = spark.createDataFrame([*((w, k, 0) for w, k in n.items() if w != "lonely"), ("lonely", 3, 1), ("lonely", 4, 2), (None, 9, 3)], "word string, n long, best int")
    assert got(variants.variant_forms(words), *COLUMNS) == plain_forms(n)
    chain = {"z" * k: 10**k for k in range(1, 9)}
    rows = got(variants.variant_forms(spark.createDataFrame([(w, k) for w, k in chain.items()], "word string, n long")), *COLUMNS)
    assert rows == plain_forms(chain) and {r[2] for r in rows} == {"z" * 8}
    assert variants.variant_forms(words.limit(0)).count() == 0


def test_variants_of_many_random_words(spark):
    rng = np.random.default_rng(5)
    n = {"".join(rng.choice(list("abé"), rng.integers(1, 7))): int(rng.integers(1, 400)) for _ in range(700)}
    assert got(variants.variant_forms(spark.createDataFrame(list(n.items()), "word string, n long")), *COLUMNS) == plain_forms(n)


def test_words_of_texts(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for drop in (199, 3, None):
        assert got(variants.corpus_words(docs, drop_one_in=drop), "word", "n") == sorted(plain_words(rows, drop).items(), key=repr)
    assert variants.corpus_words(docs.limit(0)).count() == 0


def test_spelling_query_against_plain_version(spark):
    want = plain_forms(plain_words(sf_texts(spark)))
    assert got(catalog.QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001"), *COLUMNS) == want and any(r[1] for r in want)


# Planes of token ids


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, kind in ((0, "<u4"), (1, "<u4"), (7, "<i8"), (64, "<u4"), (1001, "<i8")):
        values = rng.integers(0, 2**31, n).astype(kind)
        planes = bitplanes.to_planes(values, bits)
        assert len(planes) == values.itemsize * (8 if bits else 1)
        assert (bitplanes.from_planes(planes, n, kind, bits) == values).all()
    one = bitplanes.to_planes(np.array([1, 0, 3], "<u4"), True)
    assert one[0] == b"\x05" and one[1] == b"\x04" and one[2] == b"\0"


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip_in_blocks_and_by_place(bits):
    rng = np.random.default_rng(2)
    out = io.BytesIO()
    writer = bitplanes.Writer(out, bits, block=16)
    docs = [(None if k % 9 == 0 else k, rng.integers(0, 50_257, rng.choice([0, 1, 15, 16, 17, 100])).astype("<u4")) for k in range(60)]
    for doc, ids in docs:
        writer.end(doc, writer.add(iter([ids[:5], ids[5:]])))
    writer.close()
    reader = bitplanes.Reader(io.BytesIO(out.getvalue()))
    back = [(doc, n, np.concatenate([*parts, np.empty(0, "<u4")]).tolist()) for doc, _, n, parts in reader.documents()]
    assert back == [(doc, len(ids), ids.tolist()) for doc, ids in docs]
    every = np.concatenate([ids for _, ids in docs])
    for start, n in ((0, 1), (15, 2), (33, 400), (len(every) - 3, 3)):
        assert (np.concatenate(list(reader.ids(start, n))) == every[start : start + n]).all()
    for place in (3, 20, len(out.getvalue()) - 40, len(out.getvalue()) - 3):
        damaged = bytearray(out.getvalue())
        damaged[place] ^= 1
        with pytest.raises(bitplanes.Corrupt):
            r = bitplanes.Reader(io.BytesIO(bytes(damaged)))
            for *_, parts in r.documents():
                list(parts)
    with pytest.raises(bitplanes.Corrupt):
        bitplanes.Reader(io.BytesIO(b"short"))


@pytest.mark.parametrize("text", [t for t in ODD_TEXTS if t is not None])
def test_ids_are_the_tokenizers(byte_bpe, text):
    assert [i for p in bitplanes.byte_ids(None).of(text) for i in p.tolist()] == byte_bpe.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts_are_the_tokenizers(byte_bpe):
    rng = random.Random(1)
    encoder = bitplanes.byte_ids(None)
    for _ in range(4000):
        text = "".join(rng.choice("aZ\u00e9\u00df\u65e5\u0416'\"-.,4\u00bd\u00b2\n \t\xa0_<|>sdt\u0301\u1e3f\u00aa\u2019\r") for _ in range(rng.randint(1, 12)))
        assert [i for p in encoder.of(text) for i in p.tolist()] == byte_bpe.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_ids_of_documents_from_files(spark, docs, byte_bpe, bits):
    files = bitplanes.write_ids(docs, bits=bits, block=100, text_bytes=20_000)
    rows = [r.asDict() for r in bitplanes.read_ids(files, keep_ids=True).collect()]
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append([*byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: -1 if i is None else i)
    start, back = 0, defaultdict(list)
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
        back[r["doc_id"]].append(r["ids"])
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in back.items()}
    listed = files.orderBy("part").collect()
    assert [f["start"] for f in listed] == [sum(g["ids"] for g in listed[:k]) for k in range(len(listed))] and len(listed) > 3
    empty = bitplanes.write_ids(docs.limit(0))
    assert empty.count() == 0 and bitplanes.read_ids(empty).count() == 0


def test_planes_query_against_plain_version(spark, byte_bpe):
    want, start = [], 0
    for doc, text in sorted(sf_texts(spark)):
        ids = [*byte_bpe.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(catalog.QUERIES["op12_token_planes"](spark, "/root/testdata/sf0.001"), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


# Aligned tokens


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    characters = chunks.byte_characters()
    assert decoders.ByteLevel().decode([k for k, v in characters.items() if v < 128]) == "".join(chr(v) for k, v in characters.items() if v < 128) and sorted(characters.values()) == list(range(256))

    def tokens(text):
        one = [(i, bytes(characters[c] for c in a.id_to_token(i)) if i != 50_256 else b"<|endoftext|>") for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return one, two

    return tokens


def plain_alignment(docs, tokens):
    of, held = [], Counter()
    for doc, text in docs:
        one, two = tokens(text) if text else ([], [])
        if not text or b"".join(x for _, x in one) != (" " + text).encode() or b"".join(x for _, x in two) != (" " + text).encode():
            of.append((doc, [], []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (one, two)]
        both, groups = {*ends[0]} & {*ends[1]}, defaultdict(lambda: ([], []))
        for k, side in enumerate((one, two)):
            n = 0
            for (i, _), e in zip(side, ends[k], strict=True):
                groups[n][k].append(i)
                n += e in both
        groups = list(groups.values())
        links = [(p, q) for x, y in groups for p in x for q in y]
        held.update(set(links))
        of.append((doc, groups, links))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    digest = lambda groups: hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted(((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), digest(g)) for doc, g, links in of), key=repr)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_two_pointers_close_groups_where_both_end():
    assert alignment.align([0, 1, 2], [0, 1], [2, 3, 1], [2, 4]) == [(0, 1, 0, 1), (1, 3, 1, 2)]
    assert alignment.align([0, 0], [1], [1, 1], [1, 2]) == [(0, 2, 0, 1)]
    assert alignment.align([], [], [], []) == []


@pytest.mark.parametrize("parts_at_once", [alignment.BLOCK_PARTS, 5000])
def test_links_of_documents_against_plain_version(spark, docs, tools, parts_at_once):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_alignment(rows, tools)
    assert got(alignment.linked_counts(docs, block_parts=parts_at_once), *ALIGNED) == want
    assert sum(r[1] == 0 for r in want) >= 4 and any(r[4] > r[3] for r in want)
    assert alignment.linked_counts(docs.limit(0)).count() == 0


def test_blocks_of_any_size_count_alike(tools):
    texts = [(k, t) for k, t in enumerate(ODD_TEXTS + ["the same words", "the same", "words the"])]
    tool, whole = alignment.aligner(None, None), Counter()
    for size in (1, 4, 100):
        held = Counter()
        for lo in range(0, len(texts), size):
            block = alignment.Block()
            for doc, text in texts[lo : lo + size]:
                block.add(tool, doc, text)
            *_, pairs, docs_of = block.row(0)
            held.update({int(p): int(n) for p, n in zip(pairs, docs_of, strict=True) if n})
        assert not whole or held == whole
        whole = held


def test_pairs_of_a_group_are_counted_alike_at_any_size(monkeypatch):
    """All tokens as one group: many are counted by their different ids."""
    monkeypatch.setattr(alignment, "align", lambda a, b, size_a, size_b: [(0, len(a), 0, len(b))])
    tool = alignment.aligner(None, None)
    for n in (1, 3, 60):
        part = " the cat" * n
        a, b = tool.ids_a(part), tool.piece_ids([part])[0]
        found = tool.learn(part, b)
        keys = np.frombuffer(found[5], np.int64).tolist()
        often = [1] * len(keys) if found[6] is None else np.frombuffer(found[6], np.int64).tolist()
        assert found[2:4] == (1, len(a) * len(b)) and dict(zip(keys, often, strict=True)) == Counter(p << 32 | q for p in a for q in b)


def test_texts_that_end_in_a_blank_keep_their_tokens(spark, tools):
    """A blank alone is a part of its own, which the second tokenizer must not take for an empty text."""
    rows = [(k, t) for k, t in enumerate(["a ", "the word ", " ", "  ", "a  ", "x\n ", "word " * 300, "a \u2003", "a\u2581 ", "the word"])]
    found = got(alignment.linked_counts(spark.createDataFrame(rows, "doc_id long, text string")), *ALIGNED)
    assert found == plain_alignment(rows, tools) and sum(r[1] == 0 for r in found) == 1


def test_packed_arrays_round_trip():
    arrays = [np.array([], np.int64), np.array([5, -1, 1 << 40]), np.arange(1000)]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, alignment.unpacked(alignment.packed(*arrays)), strict=True))


def test_alignment_query_against_plain_version(spark, tools):
    assert got(catalog.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001"), *ALIGNED) == plain_alignment(sf_texts(spark), tools)
