"""Texts in chunks that tokenizers take one by one, and what was learnt of each chunk."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

#: The white space of tokenizer patterns (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])")
#: Texts without any of these have single blanks and line ends only, and are cut before each.
ODD = re.compile("[\t\v\f\r\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")
ODD_ASCII = ("\t", "\v", "\f", "\r", "\x1f", "  ", " \n", "\n ", "\n\n")
SECTION = 1 << 20  # characters of a text that are cut at once
_LETTERS, _MARKS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-/:-@\[-`{-~"
SIMPLE = re.compile(f"(\n?)( ?[{_LETTERS}]+)([{_MARKS}]*)")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIXED = re.compile(f"[{_LETTERS}][{_MARKS}]")


def chunks(text: str) -> list[str]:
    """The text cut wherever white space follows something else; joined, they are the text."""
    if any(x in text for x in ODD_ASCII) if text.isascii() else ODD.search(text):
        return CHUNK.findall(text)
    cut = text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")
    return cut if cut[0] else cut[1:]


def sections(text: str, most: int = SECTION) -> Iterator[str]:
    """The text in parts of about most characters, cut where chunks are: no text is held as chunks all at once."""
    at = 0
    while at < len(text):
        m = EDGE.search(text, at + most - 1) if at + most < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def parts(chunk: str) -> tuple[str, ...]:
    """A chunk of letters and marks as (line end, letters with their blank, marks), what there is of each; any other chunk as it is."""
    m = SIMPLE.fullmatch(chunk)
    return tuple(x for x in m.groups() if x) if m else (chunk,)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest is numbered from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class WordIds:
    """Ids of parts of chunks, without special tokens, by a tokenizer of the tokenizers library. Words of letters go straight to its
    model, where it shows on samples that it takes them so (which saves it building offsets); others go the whole way."""

    PROBES = ("a", " Zug", " \u00c0\u00d6\u00d8\u00de\u00e0\u00f6\u00f8\u00ff\u00df", " stra\u00dfe", "don", " whenin", "\u00c9t\u00e9", " \u65e5\u672c", "\u0416\u043e\u03b1")

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        shown = {b: c for c, b in byte_characters().items()}
        self.shown, self.blank = shown, shown[32]
        self.straight = byte_level_cuts(tokenizer) and all(self._of_model(w) == tokenizer.encode(w, add_special_tokens=False).ids for w in self.PROBES)

    def _of_model(self, word: str) -> list[int]:
        plain = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return [t.id for t in self.tokenizer.model.tokenize(plain)]

    def __call__(self, part: str) -> list[int]:
        if self.straight and part.removeprefix(" ").isalpha():
            return self._of_model(part)
        return self.tokenizer.encode(part, add_special_tokens=False).ids


def byte_level_cuts(tokenizer) -> bool:
    """Whether a tokenizer of the tokenizers library takes chunks one by one: its pattern keeps white space at the front of a word."""
    d = json.loads(tokenizer.to_str())
    pre = d["pre_tokenizer"] or {}
    return d["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d["post_processor"]


class Memo(dict):
    """What was learnt of strings, each when it is first asked for, in two generations: turn() makes the younger the elder when it
    has more than `most` entries, and what nobody asks for again is forgotten with it. What is longer than LONG isn't kept."""

    LONG = 100

    def __init__(self, learn: Callable[[str], object], most: int = 150_000):
        super().__init__()
        self.learn, self.most = learn, most
        self.elder: dict[str, object] = {}

    def __missing__(self, x: str):
        found = self.elder[x] if x in self.elder else self.learn(x)
        if len(x) <= self.LONG:
            self[x] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()


class Numbers(dict):
    """Strings numbered as they are first asked for; names has them in that order."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, x: str) -> int:
        self[x] = n = len(self.names)
        self.names.append(x)
        return n
