"""Byte-level BPE encoding over a trie of distinct words, and decoding (operator 6).

The encoding of a prefix is determined by its last token: taking that token
away leaves a shorter prefix, whose encoding is the rest. The last token of a
prefix is the one token that ends there and keeps its border to the last token
of the prefix before it. A trie of the distinct words of a batch therefore
needs one last token per node: they are found depth-first, each from its
ancestors on the path, so that a prefix shared by many words is encoded once.
The trie is kept as its words in order, each with the length of the path it
shares with the word before; only the path of the current word has nodes.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm import byte_bpe
from staylens.llm.common import text_or_empty

END = -1
BYTES = [bytes([b]) for b in range(256)]
#: Words a task remembers; only memory and speed depend on it.
CACHED_WORDS = 300_000


class Merges:
    """Which tokens can stand side by side in an encoding.

    Assumes that each token is made by one merge, as in byte-level
    vocabularies; a file that breaks this is refused.
    """

    def __init__(self, path: str):
        self.ids, pairs = byte_bpe.vocabulary(path)
        self.texts = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            if both in self.halves:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[left, right] = rank
            self.halves[both] = left, right, rank
        # All beginnings of tokens, each with the tokens that it ends with, once asked for.
        self.ends: dict[bytes, tuple] = {t[:n]: () for t in self.ids for n in range(1, len(t) + 1)}
        # Of these, those met so far by number, with the number that the next byte leads to.
        self.states: dict[bytes, int] = {b"": 0}
        self.strings: list[bytes] = [b""]
        self.found: list[tuple[tuple[int, int], ...]] = [()]
        self.next: dict[int, int] = {}
        self.border: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at a token's edge while it is made, each with the rank that ends it."""
        out, ended = [(token, sys.maxsize)], 0
        while token in self.halves:
            ended, token = self.halves[token][2], self.halves[token][side]
            out.append((token, ended))
        return out

    def keeps_border(self, first: int, second: int) -> bool:
        """No merge crosses the border of two tokens while both are made.

        A crossing merge happens if its rank comes before whatever consumes its
        left part, and not after whatever consumes its right part: of equal
        pairs the left one is merged first.
        """
        key = first << 32 | second
        known = self.border.get(key)
        if known is None:
            known = True
            rank, right = self.rank, self.edge(second, 0)
            for x, until in self.edge(first, 1):
                for y, until_y in right:
                    m = rank.get((x, y))
                    if m is not None and m < until and m <= until_y:
                        known = False
            if len(self.border) > 2_000_000:
                self.border.clear()
            self.border[key] = known
        return known

    def stands_alone(self, token: int) -> bool:
        """A token's own bytes are encoded as that token."""
        known = self.alone.get(token)
        if known is None:
            halves = self.halves.get(token)
            known = halves is None or (
                self.stands_alone(halves[0]) and self.stands_alone(halves[1])
                and all(
                    (m := self.rank.get((x, y))) is None or m >= halves[2] or not (m < a and m <= b)
                    for x, a in self.edge(halves[0], 1) for y, b in self.edge(halves[1], 0)
                )
            )
            self.alone[token] = known
        return known

    def step(self, key: int) -> int:
        """Number of the longest beginning of a token that ends a string and one more byte.

        ``key``: the number for the string, times 256, plus the byte.
        """
        text = self.strings[key >> 8] + BYTES[key & 255]
        while text not in self.ends:
            text = text[1:]
        state = self.states.get(text)
        if state is None:
            state = self.states[text] = len(self.strings)
            self.strings.append(text)
            self.found.append(self.ending(text))
        if len(self.next) > 2_000_000:
            self.next.clear()
        self.next[key] = state
        return state

    def ending(self, text: bytes) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that a string ends with, longest first."""
        found = ((len(text) - i, self.ids.get(text[i:])) for i in range(len(text)))
        self.ends[text] = tuple((n, t) for n, t in found if t is not None and self.stands_alone(t))
        return self.ends[text]


def build_trie(words: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """The trie of the words in depth-first order: number of a word, length of the path it shares, the word."""
    before = b""
    for number in sorted(range(len(words)), key=words.__getitem__):
        word = words[number]
        most = min(len(before), len(word))
        shared = 0
        if before[:most] == word[:most]:
            shared = most
        else:
            while before[shared] == word[shared]:
                shared += 1
        yield number, shared, word
        before = word


def encode_trie(trie: Iterable[tuple[int, int, bytes]], n_words: int, merges: Merges) -> list[list[int]]:
    """Ids of every word of a trie, by one depth-first pass.

    Besides its last token each node has the longest string that ends there and
    begins some token; the tokens that end there are its suffixes.
    """
    out: list[list[int]] = [[] for _ in range(n_words)]
    ends, border, keeps, following = merges.found, merges.border, merges.keeps_border, merges.next
    last, size, states = [0], [0], [0]
    for number, depth, word in trie:
        if len(last) <= len(word):
            more = [0] * (len(word) + 1 - len(last))
            last += more
            size += more
            states += more
        state = states[depth]
        for byte in word[depth:] if depth else word:
            key = state << 8 | byte
            state = following.get(key)
            if state is None:
                state = merges.step(key)
            depth += 1
            for n, token in ends[state]:
                if n == depth:
                    break
                pair = last[depth - n] << 32 | token
                ok = border.get(pair)
                if ok is None:
                    ok = keeps(last[depth - n], token)
                if ok:
                    break
            last[depth] = token
            size[depth] = n
            states[depth] = state
        found = []
        while depth:
            found.append(last[depth])
            depth -= size[depth]
        found.reverse()
        out[number] = found
    return out


def trie_encoder(path: str, merges: Merges | None = None) -> byte_bpe.Encoder:
    tokenizer = byte_bpe.load(path)
    merges = merges or Merges(path)
    split = byte_bpe.pretokens(tokenizer)
    ids: dict[bytes, bytes] = {}

    def encode(found: list[str]) -> list[bytes]:
        parts = [split(s) for s in found]
        if len(ids) > CACHED_WORDS:
            ids.clear()
        words = list({w for ws in parts for w in ws}.difference(ids))
        found_ids = encode_trie(build_trie(words), len(words), merges)
        ids.update((w, array("I", i).tobytes()) for w, i in zip(words, found_ids, strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in parts]

    return byte_bpe.Encoder(tokenizer.token_to_id(byte_bpe.SPECIAL), encode)


def decoder(texts: dict[int, bytes]) -> Callable[[bytes], bytes]:
    """Bytes of packed ids: places in the bytes of all tokens, looked up for many ids at once."""
    size, start = np.zeros(max(texts) + 1, np.int64), np.zeros(max(texts) + 1, np.int64)
    for i, text in texts.items():
        size[i] = len(text)
    at = np.array(list(texts))
    start[at] = np.cumsum(size[at]) - size[at]
    every = np.frombuffer(b"".join(texts.values()), np.uint8)

    def decode(packed: bytes) -> bytes:
        out = []
        ids = np.frombuffer(packed, "<u4")
        for low in range(0, len(ids), 100_000):
            part = ids[low: low + 100_000]
            n = size[part]
            ends = np.cumsum(n)
            out.append(every[np.repeat(start[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    return decode


def encode_decode(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True, with_text: bool = True,
) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if asked.

    A null text counts as empty and has no ids; the special token's string is
    one id; decoding replaces bytes that are not UTF-8. Of the trie only
    the path of one word is held. Ids, null ids and repeated rows pass through; an
    empty table gives an empty result. Other columns are ignored. No shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(tokenizer_path)
        encoder = trie_encoder(tokenizer_path, merges)
        raw = decoder({**merges.texts, encoder.special: byte_bpe.SPECIAL.encode()})
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for low, high in byte_bpe.batches(texts, 2048, 8_000_000):
                encoder.prepare(texts[low:high])
                rows = []
                for text in texts[low:high]:
                    packed = encoder.encode(text)
                    decoded = raw(packed).decode("utf-8", "replace")
                    rows.append((
                        len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                        hashlib.sha256(decoded.encode()).hexdigest(),
                        array("I", packed).tolist() if with_ids else None, decoded if with_text else None,
                    ))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(low, high - low), pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
                        *([pa.array(columns[3], pa.list_(pa.int32()))] if with_ids else []),
                        *([pa.array(columns[4], pa.string())] if with_text else []),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256",
                           *(["ids"] if with_ids else []), *(["decoded"] if with_text else [])],
                )

    schema = (
        f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")
    )
    out = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
