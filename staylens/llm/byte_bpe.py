"""Byte-level BPE helpers around a public tokenizer file: splitting texts and word caches."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

# The splitting pattern of the byte-level vocabulary, for
# characters on which Python's classes and the tokenizer's agree, and in full.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Printable ASCII, tab, newline, and Latin letters; anything else is split by
# the tokenizer itself.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")
#: Runs of white space from here on (and so texts from here on) are left to the tokenizers library.
LONG_RUN = 100_000
LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")
INNER_SPACE = re.compile(r" (?:\s|$)")
SPECIAL = "<|endoftext|>"
#: Words a task remembers; only memory and speed depend on it.
CACHED_WORDS = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = [""] * 256
    for b in kept:
        letters[b] = chr(b)
    for extra, b in enumerate(b for b in range(256) if not letters[b]):
        letters[b] = chr(256 + extra)
    return letters


def segments(text: str) -> list[str]:
    """Cut a text where a single space precedes a word.

    The pattern never matches across these places, so segments can be encoded
    on their own. Runs of white space stay inside the segment before.
    """
    parts = text.split(" ")
    if not INNER_SPACE.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return [s for s in out if s]


class Encoder(dict):
    """Segment without its leading space -> its ids as little-endian bytes.

    ``encode_segments`` maps a list of new segments to their ids as bytes; it
    may rely on none of them holding the special token.
    """

    def __init__(self, special: int, encode_segments: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.special, self.encode_segments = special, encode_segments
        self.heads: dict[str, bytes] = {}

    def prepare(self, texts: list[str]) -> None:
        """Encode all new segments of a batch together."""
        if len(self) + len(self.heads) > CACHED_WORDS:
            self.clear()
            self.heads.clear()
        new: set[str] = set()
        heads: set[str] = set()
        for text in texts:
            for piece in text.split(SPECIAL) if SPECIAL in text else (text,):
                if INNER_SPACE.search(piece):
                    for s in segments(piece):
                        (new.add(s[1:]) if s[0] == " " and len(s) > 1 else heads.add(s))
                else:
                    head, *rest = piece.split(" ")
                    new.update(rest)
                    heads.add(head)
        new.difference_update(self.keys())
        heads.difference_update(self.heads.keys())
        body, head = list(new), list(heads)
        self.update(zip(body, self.encode_segments([" " + s for s in body]), strict=True))
        self.heads.update(zip(head, self.encode_segments(head), strict=True))

    def encode(self, text: str) -> bytes:
        """Ids of a text of the prepared batch."""
        if SPECIAL in text:
            return array("I", [self.special]).tobytes().join(self._piece(p) for p in text.split(SPECIAL))
        return self._piece(text)

    def _piece(self, text: str) -> bytes:
        if INNER_SPACE.search(text):
            return b"".join(
                [self[s[1:]] if s[0] == " " and len(s) > 1 else self.heads[s] for s in segments(text)]
            )
        head, *rest = text.split(" ")
        return self.heads[head] + b"".join(map(self.__getitem__, rest))


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pretokens(tokenizer) -> Callable[[str], list[bytes]]:
    """Split of a segment into the byte strings that are merged on their own."""
    from_letter = {ord(c): b for b, c in enumerate(byte_letters())}
    by_library = tokenizer.pre_tokenizer.pre_tokenize_str

    def split(segment: str) -> list[bytes]:
        plain = segment.isascii() and segment.isprintable() or PLAIN.fullmatch(segment)
        if plain and segment[1:].isalpha() and segment[0] == " ":
            return [segment.encode()]
        if plain:
            return [w.encode() for w in PRETOKEN.findall(segment)]
        return [bytes(map(from_letter.__getitem__, map(ord, w))) for w, _ in by_library(segment)]

    return split


def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids of the byte strings of a tokenizer file, and its merges in order."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    from_letter = {c: b for b, c in enumerate(byte_letters())}

    def raw(token: str) -> bytes:
        return bytes(map(from_letter.__getitem__, token))

    ids = {raw(t): i for t, i in model["vocab"].items() if all(c in from_letter for c in t) and t != SPECIAL}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return ids, [(raw(a), raw(b)) for a, b in pairs]


def text_encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a whole text as little-endian bytes, by a compiled merger over the file's vocabulary.

    Its ids equal those of the tokenizers library (the pattern was compared on
    every code point), at five times the speed. The merger's splitting fails on
    very long runs of white space; parts with such a run go to the library.
    """
    import tiktoken

    library = load(path)
    special = array("I", [library.token_to_id(SPECIAL)]).tobytes()
    merge = tiktoken.Encoding(
        "file", pat_str=PATTERN, mergeable_ranks=vocabulary(path)[0], special_tokens={}
    ).encode_ordinary

    def ids(part: str) -> list[int]:
        if len(part) >= LONG_RUN and LONG_SPACE.search(part):
            return library.encode(part, add_special_tokens=False).ids
        return merge(part)

    return lambda text: special.join(array("I", ids(part)).tobytes() for part in text.split(SPECIAL))


def batches(texts, count: int = 512, chars: int = 4_000_000):
    """Slices of a list of texts, bounded in number and in characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if i - start + 1 >= count or size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
