"""Grouping of spelling variants through a reduced alphabet (operator 12).

Letters are hashed to a few symbols. Words one edit apart have reduced words at
most one edit apart, so each word joins the reduced vocabulary under the full
one-edit neighbourhood of its own reduced word, and pairs found that way are
verified on the words themselves. Reduced words stand as 64-bit polynomial
hashes: those of a whole neighbourhood follow from prefix sums, at a cost that does
not depend on how long each neighbour is; chance collisions are refused with
the other wrong pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import text_or_empty, written

#: Letters of the reduced alphabet.
SYMBOLS = 16
#: Different words a task counts before it passes them on.
COUNTED_WORDS = 200_000
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 22
#: Words up to this many bytes have their hash with the document's put together from parts.
JOINED_BYTES = 64
#: Keys that a task makes at once.
KEYS_AT_ONCE = 1 << 20
#: Bits of the filter for reduced words that no word has: 8 MiB, whatever the input.
KEY_BITS = 1 << 26

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), 0xC3]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def cut_words(texts: pa.Array) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """Maximal runs of letters, A-Z as a-z, and the number of each one's text, piece by piece.

    Works on the UTF-8 bytes: U+00C0 to U+00FF are 0xC3 and any byte after it. A
    piece ends where no run goes on, so a run is never cut.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start, stop = int(offsets[0]), int(offsets[-1])
    while start < stop:
        end = min(start + PIECE_BYTES, stop)
        while end < stop and (LETTERS[data[end]] or data[end - 1] == 0xC3):
            end += 1
        piece = data[start:end]
        letter = LETTERS[piece]
        letter[1:] |= piece[:-1] == 0xC3
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        edges = offsets[np.searchsorted(offsets, start, "right"): np.searchsorted(offsets, end, "left")] - start
        first[edges] = letter[edges]
        last[edges - 1] = letter[edges - 1]
        at = np.nonzero(first)[0]
        ends = np.concatenate([[0], np.cumsum(np.nonzero(last)[0] + 1 - at)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(LOWER[piece[letter]])))
        yield words.dictionary_encode(), np.searchsorted(offsets, at + start, "right") - 1
        start = end


def hashes(words: pa.Array, codes: np.ndarray, owner: np.ndarray, ids: list[bytes]) -> np.ndarray:
    """crc32 of the id, a colon and the word, for each pair of a word's code and the number of its id.

    The crc of two parts is the first one's, moved on by as many zero bytes as the
    second has, xor the second one's. So words and ids are hashed once each.
    """
    plain = [w.encode() for w in words.to_pylist()]
    own = np.array([zlib.crc32(w) for w in plain], np.uint32)
    length = np.array([len(w) for w in plain])
    low, high = owner.min(), owner.max()
    heads = np.array([zlib.crc32(i + b":") for i in ids[low: high + 1]], np.uint32)
    moved = [heads]
    for _ in range(min(JOINED_BYTES, length.max())):
        moved.append(CRC[moved[-1] & 0xFF] ^ moved[-1] >> 8)
    out = own[codes] ^ np.stack(moved)[np.minimum(length[codes], len(moved) - 1), owner - low]
    for i in np.nonzero(length[codes] > JOINED_BYTES)[0]:
        out[i] = zlib.crc32(plain[codes[i]], int(heads[owner[i] - low]))
    return out


def _counted(counts: Counter, ids: pa.Array, texts: pa.Array, every: int | None) -> None:
    """Adds the words of some texts to the counts."""
    heads = [b"" if i is None else i.encode() for i in ids.to_pylist()]
    for found, owner in cut_words(texts):
        if not len(owner):
            continue
        words, codes = found.dictionary, found.indices.to_numpy()
        n = np.bincount(codes, minlength=len(words))
        if every:
            h = hashes(words, codes, owner, heads)
            for i in np.nonzero(h % np.uint32(every) == 0)[0]:
                word = words[int(codes[i])].as_py()
                at = int(h[i]) % len(word)
                counts[word[:at] + word[at + 1:]] += 1
                n[codes[i]] -= 1
        for word, times in zip(words.to_pylist(), n.tolist(), strict=True):
            counts[word] += times


def count_words(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3,
    every: int | None = None,
) -> DataFrame:
    """(word, n) of words with at least ``least_chars`` letters that occur ``least_count`` times.

    With ``every``, about one in that many different words of a document is
    misspelt on purpose. A null text has no words; a null id counts as an empty
    one; repeated rows count again; other columns are ignored; an empty table
    gives an empty result. Words are counted in the tasks before they are shuffled.
    """

    def flushed(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if n and len(w) >= least_chars]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
            names=["word", "n"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for frame in frames:
            _counted(counts, frame.column(0), frame.column(1), every)
            if len(counts) > COUNTED_WORDS:
                yield flushed(counts)
        yield flushed(counts)

    counted = df.select(F.col(id_col).cast("string"), text_or_empty(text_col)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols(word: str, count: int) -> np.ndarray:
    """The reduced word: a symbol from 1 for each letter."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (points * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(count) + np.uint64(1)


def reduced_key(word: str, count: int, powers: np.ndarray) -> int:
    r = symbols(word, count)
    return int((r * powers[: len(r)]).sum(dtype=np.uint64))


def neighbourhoods(words: list[str], count: int, powers: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of all reduced words at most one edit from those of words of one length: arrays with a row per word."""
    m = len(words[0])
    r = symbols("".join(words), count).reshape(len(words), m)
    p = powers[: m + 1]
    before = np.concatenate(
        [np.zeros((len(words), 1), np.uint64), np.cumsum(r * p[:m], axis=1, dtype=np.uint64)], axis=1)
    total = before[:, -1:]
    yield before[:, :-1] + (total - before[:, 1:]) * np.uint64(INVERSE)
    shifted = before + (total - before) * np.uint64(BASE)
    # As many letters at once as fit a block of keys.
    some = max(1, KEYS_AT_ONCE // (len(words) * (m + 1)))
    for start in range(1, count + 1, some):
        letters = np.arange(start, min(start + some, count + 1), dtype=np.uint64)[:, None]
        yield (total[:, None] + (letters - r[:, None]) * p[:m]).reshape(len(words), -1)
        yield (shifted[:, None] + letters * p).reshape(len(words), -1)


class Powers:
    """Powers of the base, as many as the longest word so far needs."""

    def __init__(self):
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) <= n:
            step = np.uint64(pow(BASE, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known


def _keyed(words: DataFrame, count: int) -> DataFrame:
    """(key, near, near_n): the reduced vocabulary."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for frame in frames:
            own = frame.column(0).to_pylist()
            keys = [reduced_key(w, count, powers.upto(len(w))) for w in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), frame.column(0), frame.column(1)],
                names=["key", "near", "near_n"])

    return words.select("word", "n").mapInArrow(run, "key long, near string, near_n long")


def used_bits(keyed: DataFrame) -> bytes:
    """Bitmap of fixed size in which the bits of all reduced words are set."""
    number = F.col("key").bitwiseAND(F.lit(KEY_BITS - 1)) + 1
    slices = keyed.groupBy(F.bitmap_bucket_number(number).alias("slice")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = bytearray(KEY_BITS // 8)
    # At most KEY_BITS / 32768 rows of 4 KiB.
    for row in slices.collect():
        at = (row["slice"] - 1) * 4096
        out[at: at + 4096] = row["bits"]
    return bytes(out)


def _neighbours(words: DataFrame, count: int, used) -> DataFrame:
    """(key, word, n) for the neighbourhood of each word, as far as some word may have that key."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), np.frombuffer(used.value, np.uint8)

        for frame in frames:
            own = frame.column(0).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, word in enumerate(own):
                by_length.setdefault(len(word), []).append(i)
            for m, group in by_length.items():
                step = max(1, KEYS_AT_ONCE // ((2 * count + 1) * (m + 1)))
                for start in range(0, len(group), step):
                    part = np.array(group[start: start + step])
                    found = []
                    for keys in neighbourhoods([own[i] for i in part], count, powers.upto(m)):
                        keys = keys.view(np.int64)
                        bit = keys & (KEY_BITS - 1)
                        at, where = np.nonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                        found.append(np.stack([part[at], keys[at, where]]))
                    at, keys = np.unique(np.concatenate(found, axis=1), axis=1)
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), frame.column(0).take(rows), frame.column(1).take(rows)],
                        names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_words(words: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of different words that one edit turns into each other.

    The join is merged by hint: Spark sizes a neighbourhood like the stored words
    it is made of, by some megabytes of file, and would broadcast its many rows.
    """
    keyed = written(_keyed(words, count), "spelling-reduced")
    used = words.sparkSession.sparkContext.broadcast(used_bits(keyed))
    pairs = _neighbours(words, count, used).join(keyed.hint("merge"), "key")
    apart = F.abs(F.length("word") - F.length("near")) <= 1
    return pairs.where(
        (F.col("word") != F.col("near")) & apart & (F.levenshtein("word", "near", 1) == 1)
    ).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word that forms lead to.

    Pointers double in each round; counts at least double along a chain, so the
    rounds grow with the logarithm of that of the largest count. Words that
    arrived are looked up but no longer moved, so many words of one root do not meet again.
    Joins are merged by hint, as rows take many times the file that Spark sizes them by.
    """
    state = written(forms.select("word", F.col("form").alias("to"), F.lit(False).alias("done")), "spelling-steps")
    while True:
        open_ = state.where("not done")
        if open_.isEmpty():
            return state.select("word", F.col("to").alias("root"))
        ahead = state.select(F.col("word").alias("at"), F.col("to").alias("next"))
        moved = open_.join(ahead.hint("merge"), F.col("to") == F.col("at"), "left").select(
            "word", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("done"))
        state = written(state.where("done").union(moved), "spelling-steps")


def variant_groups(words: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``words`` holds distinct words with their counts. Two words are near if
    one inserted, deleted or replaced code point turns one into the other. The
    form of a word is its near word of largest count (ties: the smallest in
    code-point order), if that is at least twice its own, else null; the root is
    the word that following forms ends at. Null words have no row; an empty table
    gives an empty result; words may have any length.
    """
    words = written(words.where("word is not null").select("word", "n"), "spelling-words")
    found = near_words(words, count).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    joined = written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.rank") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.rank") >= 2 * F.col("n"), -F.col("best.rank")).alias("form_n")), "spelling-forms")
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
