"""Document fingerprints by consistent weighted sampling (operator 13).

A document's terms are its words, a term's weight is how often it occurs. For
each of the samples, hashes of term and sample number give two Gamma(2, 1)
values r and c and a uniform value b. A term of weight S has the step
t = floor(ln S / r + b) and the rank ln c - r (t - b + 1); the sample is the term of
least rank with its step. Two documents agree in a sample with the probability of
their generalised Jaccard similarity, the sum of smaller weights over the sum of
larger ones. Everything runs on built-in functions.

The gamma values come from their distribution at the middles of equally likely
cells, so that a draw is a look-up by hash bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.llm.common import positions, text_or_empty, written

#: Samples of a fingerprint, and how many of them are drawn side by side.
SAMPLES, WIDTH = 32, 4
#: Ids that are consecutive by value share a block, within which a document meets the next one.
BLOCK_IDS = 1024
#: Hash bits that choose a cell of a gamma value, and that place the uniform one.
CELL_BITS, B_BITS = 12, 20


def gamma_quantiles(bits: int = CELL_BITS) -> np.ndarray:
    """Gamma(2, 1) at the middles of 2**bits equally likely cells: solves 1 - exp(-x) (1 + x) = u."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(u), np.full_like(u, 64.0)
    for _ in range(80):
        x = (low + high) / 2
        above = -np.expm1(-x) - x * np.exp(-x) > u
        low, high = np.where(above, low, x), np.where(above, x, high)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """Numbers as one constant; as text they are folded once, while an array of literals is planned one by one."""
    return F.from_json(F.lit("[" + ",".join(f"{v:.5f}" for v in values) + "]"), "array<double>")


def draws(term: Column, sample: Column) -> dict[str, Column]:
    """r, ln c, b and an identity of a term's sample, all from one hash."""
    x = F.xxhash64(term, sample)

    def bits(at: int, n: int) -> Column:
        return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1))

    uniform = (bits(2 * CELL_BITS, B_BITS) + 0.5) / float(1 << B_BITS)
    cell = bits(CELL_BITS, CELL_BITS)
    # In the first cell, where u is nearly c * c / 2, further bits place c.
    fine = (bits(44, 20) + 0.5) / float(1 << 20 + CELL_BITS)
    return {
        "r": F.get(_table(gamma_quantiles()), bits(0, CELL_BITS).cast("int")),
        "c": F.when(cell == 0, F.log(fine * 2) / 2).otherwise(
            F.get(_table(np.log(gamma_quantiles())), cell.cast("int"))),
        "b": uniform, "x": F.shiftrightunsigned(x, 38).cast("double"),
    }


def sample_code(i: int, log_weight: Column) -> Column:
    """Rank first, then bits of the term: the least code is the sample, and equal codes mean equal term and step.

    Ranks lie between -60 and 5; a whole number below 2**53 holds rank and bits.
    """
    r, c, b, x = (F.col(f"{name}{i}") for name in "rcbx")
    rank = c - r * (F.rint(log_weight / r + b - 0.5) - b + 1)
    return F.rint((rank + 64) * float(1 << 20)) * float(1 << 26) + x


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _long(text: Column, part: int) -> Column:
    """16 hexadecimal digits as a number, so that a grouped maximum can carry a digest."""
    return F.conv(F.substring(text, 1 + 16 * part, 16), 16, -10).cast("long")


def _in_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their place in a block and the next document's text, descending id (after the last: the first).

    A block also holds, marked ``extra``, the first row of the block that follows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body")).withColumn(
        "block", F.floor(F.col("id") / BLOCK_IDS).cast("long")).withColumn("tie", F.xxhash64("body"))
    heads = rows.groupBy("block").agg(F.max("id").alias("head"))
    # Places count up from null; the block before one is that with the next place, or the first again.
    heads = positions(heads.withColumn("tree", F.lit(0)), "tree", "block", label="fingerprint-blocks")
    follows = heads.select(
        "block", "head", F.when(F.col("pos") + 1 < F.col("n"), F.col("pos") + 1).otherwise(0).alias("before"))
    follows = written(
        follows.join(heads.select(F.col("block").alias("home"), F.col("pos").alias("before")), "before")
        .select(F.col("block").alias("of"), "head", "home"), "fingerprint-follows")
    extra = (
        rows.join(follows, F.col("block").eqNullSafe(F.col("of")) & F.col("id").eqNullSafe(F.col("head")))
        .groupBy("home", "id").agg(F.min(F.struct("tie", "body")).alias("first"))
        .select("id", F.col("first.body").alias("body"), F.col("home").alias("block"), "first.tie",
                F.lit(True).alias("extra"))
    )
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    order = Window.partitionBy("block").orderBy("extra", F.desc_nulls_last("id"), "tie")
    return both.select(
        "block", F.row_number().over(order).alias("place"), "id", "body", "extra",
        F.lead("body").over(order).alias("after"))


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text is the document's with its last ``floor(n_chars / 2)`` code
    points replaced by the first as many (or all) of the next document in
    descending id; after the last comes the first. Fingerprints are 8 hexadecimal
    digits per sample; ``near_*`` is the share of equal samples. Words are runs without white space;
    a text without words has a fingerprint of its own, equal only to that of
    another such text. A null text counts as empty, a null id is the smallest;
    rows that repeat an id follow each other by a hash of their text; an empty
    table gives an empty result; other columns are ignored.

    Texts are shuffled once, by blocks of neighbouring ids; what follows keeps
    that partitioning.
    """
    if samples % WIDTH:
        raise ValueError(f"samples come in multiples of {WIDTH}")
    body = F.col("body")
    half = F.floor(F.length(body) / 2).cast("int")
    cut = F.concat(
        F.substring(body, F.lit(1), F.length(body) - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    carried = ["id", "extra", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    texts = _in_blocks(df, id_col, text_col).select(
        "block", "place", "id", F.col("extra").cast("int").alias("extra"), F.length(body).cast("long").alias("n_chars"),
        "body", F.when(F.col("extra"), "").otherwise(cut).alias("edited"))
    # All that concerns a document is settled before its words become rows.
    texts = texts.select(
        "block", "place", "id", "extra", "n_chars", *[_long(F.sha2("edited", 256), i).alias(f"sha{i}") for i in range(4)],
        _words(body).alias("own"), _words(F.col("edited")).alias("other"))
    words = texts.select(
        "block", "place", *carried, F.size("own").alias("n_own"),
        F.posexplode(F.concat("own", "other")).alias("at", "word"))
    of_own = F.col("at") < F.col("n_own")
    real = F.col("word") != ""
    passed = [F.max(name).alias(name) for name in carried]
    # Empty pieces of a split stay as one term without weight, so that each document has a row.
    terms = words.select(
        "block", "place", *carried, F.xxhash64("word").alias("term"), (of_own & real).alias("in_own"),
        (~of_own & real).alias("in_edited"),
    ).groupBy("block", "place", "term").agg(
        F.count_if("in_own").alias("n_own"), F.count_if("in_edited").alias("n_edited"), *passed)
    drawn = terms.select(
        "block", "place", "term", *carried, *[
            F.when(F.col(f"n_{s}") > 0, F.log(F.col(f"n_{s}").cast("double"))).alias(f"log_{s}")
            for s in ("own", "edited")],
        F.explode(F.array(*[F.lit(i) for i in range(samples // WIDTH)])).alias("turn"))
    drawn = drawn.select(
        "block", "place", "turn", *carried, "log_own", "log_edited",
        *[c.alias(f"{name}{i}") for i in range(WIDTH)
          for name, c in draws(F.col("term"), F.col("turn") * WIDTH + i).items()])
    codes = [
        F.min(sample_code(i, F.col(f"log_{s}"))).alias(f"{s}{i}") for i in range(WIDTH) for s in ("own", "edited")]
    turns = drawn.groupBy("block", "place", "turn").agg(*codes, *passed)
    one = turns.groupBy("block", "place").agg(
        F.sort_array(F.collect_list(F.struct(
            "turn", *[F.array(*[F.coalesce(F.col(f"{s}{i}"), F.lit(-1.0)) for i in range(WIDTH)]).alias(s) for s in ("own", "edited")]))).alias("turns"), *passed)
    signed = one.select(
        "block", "place", *carried, F.flatten("turns.own").alias("own"), F.flatten("turns.edited").alias("edited"))
    order = Window.partitionBy("block").orderBy("place")
    ahead = signed.withColumn("after", F.lead("own").over(order)).where("extra = 0")

    def text(signature: str) -> Column:
        return F.array_join(F.transform(signature, lambda v: F.substring(F.lower(F.hex(F.xxhash64(v))), -8, 8)), "")

    def alike(other: str) -> Column:
        return F.size(F.filter(F.zip_with("own", other, lambda x, y: x == y), lambda same: same)) / float(samples)

    return ahead.select(
        F.col("id").alias(id_col), "n_chars",
        F.concat(*[F.lpad(F.lower(F.hex(f"sha{i}")), 16, "0") for i in range(4)]).alias("edited_sha256"),
        text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"),
        alike("edited").alias("near_edited"), alike("after").alias("near_next"))
