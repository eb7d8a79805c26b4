"""Merkle manifest, spelling variants and fingerprints against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from staylens.llm import fingerprints, merkle, spelling
from staylens.llm.common import written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """Root, and the siblings of each leaf with the side they stand on."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(nodes):
                paths[i].append((p ^ 1 < p, nodes[p ^ 1]))
            else:
                paths[i].append((False, ""))
        nodes = [h("".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def fold(leaf, path):
    for left, other in path:
        leaf = h(other + leaf if left else leaf + other)
    return leaf


def brute_manifest(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subroots, trees = [], [], {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]])
        subroots.append(trees[g][0])
    root, tops = tree_of(subroots)
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            shown = list(r)
            if tampered(r) and r[3] is not None:
                shown[3] += 1
            whole = path + top
            folded = fold(leaf_of(shown), whole)
            out.append((r[0], leaf_of(r), trees[g][0], root, [s for _, s in whole if s], folded, folded == root))
    return out


@pytest.mark.parametrize("block, sizes", [(4, [1, 2, 3, 37, 16, 5]), (2, [9]), (1024, [40, 1])])
def test_manifest(spark, monkeypatch, block, sizes):
    monkeypatch.setattr(merkle, "SUPERBLOCK", block)
    rnd, rows = random.Random(block), []
    for k, size in enumerate(sizes):
        lang = [None, "en", "é", "z", "de", ""][k]
        rows += [(len(rows) + i, rnd.choice(["a", None, ""]), lang, rnd.choice([None, i]),
                  rnd.choice(["", None, "x" * 3000, "é 1"])) for i in range(size)]
    rows += [rows[0], (None, None, "en", None, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("id", "pos", "n", "tree", "hash", "block", "steps", "root", "presented")})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(df, FIELDS, "lang", presented={
        "n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]
    want = brute_manifest(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merkle.manifest(df.limit(0), FIELDS, "lang").count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_groups(counts):
    found = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        found[w] = (n, len(others), form, counts.get(form))
    out = {}
    for w, (n, k, form, form_n) in found.items():
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        out[w] = (n, k, form, form_n, root)
    return out


@pytest.mark.parametrize("symbols", [2, 16])
def test_variant_groups(spark, symbols):
    rnd = random.Random(symbols)
    counts = {"".join(rnd.choice("abÀÿ") for _ in range(rnd.randint(3, 6))): 2 ** rnd.randint(0, 9) for _ in range(150)}
    counts |= {"q" * 20_000: 9, "q" * 19_999: 3, "q" * 9_000 + "r" + "q" * 10_999: 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("key", F.lit("x"))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variant_groups(df, symbols).collect()}
    assert got == brute_groups(counts)
    assert spelling.variant_groups(df.limit(0)).count() == 0
    assert spelling.variant_groups(df.withColumn("word", F.lit(None).cast("string"))).count() == 0


def test_chain_of_forms(spark):
    chain = {"aaaaa" + "b" * i: 2 ** (20 - i) for i in range(20)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r.root for r in spelling.variant_groups(df).collect()} == {"aaaaa"}


def test_stored_sizes_choose_no_broadcast(spark, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "written", lambda df, label: written(planned(df) if "steps" in label else df, label))
    counts = [("aaaaa" + "b" * i, 2 ** (20 - i)) for i in range(9)]
    df = written(spark.createDataFrame(counts, "word string, n long"), "words")
    assert planned(spelling.near_words(df)).count() == 16
    assert planned(spelling.variant_groups(df)).count() == 9
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 3
    assert not any("BroadcastExchange" in p for p in joins)


def test_count_words(docs, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_BYTES", 7)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 3)
    texts = [None, "", "Straße straße STRASSE, ÀÉ×÷", "straße" * 9 + " wordy" * 40, "wordy-wordy\nWORDY ÉTUDE étude", "Kſ K"] * 30
    every = 5
    want = Counter()
    import re
    for i, t in enumerate(texts):
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
            code = zlib.crc32(f"{i}:{run}".encode())
            if code % every == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1:]
            want[run] += 1
    got = {r.word: r.n for r in spelling.count_words(docs(texts), every=every).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    plain = {r.word: r.n for r in spelling.count_words(docs(texts), least_chars=1, least_count=1).collect()}
    assert plain["wordy"] == 43 * 30 and plain["strasse"] == 30


TEXTS = [None, "", "one two three four", "one two three four", "x", "  ", "é " * 501, "word " * 4000, "a b c d e f g h i j"]


def generalised_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


@pytest.mark.parametrize("block", [1, 1024])
def test_fingerprints(spark, clashing, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK_IDS", block)
    df = clashing(TEXTS).withColumns({c: F.lit(0) for c in ("block", "place", "extra", "tie", "own", "term", "turn")})
    rows = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[i - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        row = rows[i]
        assert row.n_chars == len(t) and row.edited_sha256 == h(edited)
        assert len(row.fingerprint) == len(row.edited_fingerprint) == 8 * fingerprints.SAMPLES
        assert abs(row.near_edited - generalised_jaccard(t, edited)) <= 0.35
        assert abs(row.near_next - generalised_jaccard(t, after)) <= 0.35
        assert (row.near_next == 1.0) == (t.split() == after.split())
    assert rows[2].fingerprint == rows[3].fingerprint and rows[0].fingerprint == rows[1].fingerprint
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_fingerprints_of_odd_ids(spark):
    rows = [(None, "n"), (5, "a b"), (5, "c d"), (5, "a b"), (-3, "m n o p"), (10**12, "z z")]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].edited_sha256 == h("n") and by_id[-3].edited_sha256 == h("m n n")
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()[0]
    assert (one.edited_sha256, one.near_next) == (h("a a"), 1.0)


def test_collisions_follow_weights(spark):
    """Over many pairs the share of equal samples is the generalised Jaccard similarity, without bias."""
    rnd, texts = random.Random(5), []
    for pair in range(120):
        # Each pair has words of its own, so that its draws do not depend on those of other pairs.
        for _ in range(2):
            texts.append(" ".join(f"p{pair}w{int(rnd.paretovariate(0.5)) % 900}" for _ in range(80)))
    rows = {r.doc_id: r for r in fingerprints.fingerprints(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    errors = [
        rows[i].near_next - generalised_jaccard(texts[i], texts[i - 1]) for i in range(1, len(texts), 2)]
    assert abs(sum(errors) / len(errors)) < 0.03
    assert max(map(abs, errors)) < 0.4
