"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 4).

A word is its own vector next to the mean of the vectors of its character
n-grams, both hashed. Overlapping windows of words run through a gated recurrent
network in both directions; attention pools its states into one logit. The score
of a document is that of its highest window, for all windows of the whole text.
The network is trained in numpy on a bounded sample of labelled rows, in one
task: the driver sees its parameters, no texts. Only document labels exist, so in each round a toxic document stands for its highest
window, and a clean document for its highest and a random one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import text_or_empty

WINDOW, STRIDE = 48, 36
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN, ATTENTION = 1 << 13, 1 << 15, 8, 8, 8
GRAMS = (3, 4, 5, 7)
#: Labelled rows of each class that a model is fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS = 1200, 2400
ROUNDS = 6
LEAST_STEPS = 160
THRESHOLD = 0.3
#: Parts of the labelled rows, each judged by a network that has not seen it, to place the threshold.
FOLDS = 3
#: Words a task remembers; only memory and speed depend on it.
CACHED_WORDS = 150_000

# ASCII letters and digits stay, other ASCII bytes separate words.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Bucket of each word; and per n-gram size the buckets and the word each belongs to."""
    buffer = np.frombuffer(b" " + b" ".join(words) + b" " * max(GRAMS), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(words) else lengths
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    # Last position of the space after each word.
    end = starts[owner] + lengths[owner] + 2
    place = np.arange(len(owner))
    prime = np.uint64(0x9E3779B97F4A7C15)
    code = buffer * prime
    grams = []
    for n in GRAMS:
        h = np.full(len(owner), n, np.uint64)
        for k in range(n):
            h = (h ^ code[k: k + len(owner)]) * prime
            h ^= h >> np.uint64(29)
        inside = place + n <= end
        grams.append(((h[inside] >> np.uint64(20)).astype(np.int64) & (GRAM_BUCKETS - 1), owner[inside]))
    sums = np.zeros(len(words), np.uint64)
    at = (place.astype(np.uint64) - starts[owner].astype(np.uint64) + np.uint64(1)) * prime
    spread = (code[: len(owner)] ^ at) * prime
    np.add.at(sums, owner, spread ^ (spread >> np.uint64(31)))
    return ((sums * prime) >> np.uint64(40)).astype(np.int64) & (WORD_BUCKETS - 1), grams


def flat_features(words: list[bytes], slab: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, and the n-gram buckets of all words one after another with their bounds."""
    buckets, counts, grams = [], [], []
    for k in range(0, len(words), slab):
        bucket, parts = word_features(words[k: k + slab])
        owner = np.concatenate([o for _, o in parts])
        order = np.argsort(owner, kind="stable")
        buckets.append(bucket.astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(bucket)))
        grams.append(np.concatenate([g for g, _ in parts])[order].astype(np.int32))
    begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return np.concatenate(buckets), begin, np.concatenate(grams)


def _gram_means(grams: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, n_words: int) -> np.ndarray:
    total = np.zeros((n_words, table.shape[1]))
    count = np.zeros(n_words)
    for buckets, owner in grams:
        count += np.bincount(owner, minlength=n_words)
        for d in range(table.shape[1]):
            total[:, d] += np.bincount(owner, weights=table[buckets, d], minlength=n_words)
    return (total / np.maximum(count, 1)[:, None]).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents' windows: document, first word, end of the document (in their joined words)."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), count)
    ends = np.cumsum(lengths)
    number = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    return doc, (ends - lengths)[doc] + number * STRIDE, ends[doc]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        h, d = HIDDEN, 2 * WIDTH
        self.p = {
            "word": normal(0.3, WORD_BUCKETS, WIDTH), "gram": normal(0.6, GRAM_BUCKETS, WIDTH),
            "wx": normal(1 / math.sqrt(d), 2, d, 3 * h), "bx": np.zeros((2, 1, 3 * h), np.float32),
            "u": normal(1 / math.sqrt(h), 2, h, 3 * h), "wa": normal(1 / math.sqrt(2 * h), 2 * h, ATTENTION),
            "va": normal(1.0, ATTENTION), "wo": normal(0.5, 2 * h), "bo": np.full(1, -1.0, np.float32),
        }
        # Logit of a document = scale * highest logit + shift.
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, features) -> np.ndarray:
        bucket, grams = features
        return np.concatenate([self.p["word"][bucket], _gram_means(grams, self.p["gram"], len(bucket))], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates: (2, words, 3 * hidden)."""
        return np.matmul(x[None], self.p["wx"]) + self.p["bx"]

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; gates (2, windows, time, 3h) with the second direction reversed in time."""
        h, (_, n, t, _) = HIDDEN, gates.shape
        states = np.zeros((2, n, t, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        on = np.stack([mask, mask[:, ::-1]])[..., None]
        kept = []
        for i in range(t):
            rec = np.matmul(state, self.p["u"])
            zr = _sigmoid(gates[:, :, i, : 2 * h] + rec[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = 2 * _sigmoid(2 * (gates[:, :, i, 2 * h:] + r * rec[..., 2 * h:])) - 1
            before = state
            m = on[:, :, i]
            state = before + m * (1 - z) * (new - before)
            states[:, :, i] = state
            if keep:
                kept.append((before, z, r, new, rec[..., 2 * h:], m))
        both = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        u = np.tanh(both @ self.p["wa"])
        e = np.where(mask > 0, u @ self.p["va"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        c = np.einsum("nt,ntk->nk", a, both)
        return c @ self.p["wo"] + self.p["bo"][0], (both, u, a, c, kept)

    def gradients(self, dlogit: np.ndarray, mask: np.ndarray, memory) -> tuple[dict, np.ndarray]:
        """Of the weights, and of the gates' inputs."""
        both, u, a, c, kept = memory
        h, g = HIDDEN, {}
        g["wo"], g["bo"] = c.T @ dlogit, np.array([dlogit.sum()])
        dc = dlogit[:, None] * self.p["wo"]
        da = np.einsum("ntk,nk->nt", both, dc)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", de, u)
        du = de[..., None] * self.p["va"] * (1 - u * u)
        g["wa"] = np.einsum("ntk,nta->ka", both, du)
        dboth = a[..., None] * dc[:, None] + du @ self.p["wa"].T
        dstates = np.stack([dboth[..., :h], dboth[:, ::-1, h:]])
        _, n, t, _ = dstates.shape
        dgates = np.zeros((2, n, t, 3 * h), np.float32)
        g["u"] = np.zeros_like(self.p["u"])
        dstate = np.zeros((2, n, h), np.float32)
        for i in reversed(range(t)):
            before, z, r, new, rec, m = kept[i]
            d = dstate + dstates[:, :, i]
            dn = d * m * (1 - z) * (1 - new * new)
            dz = d * m * (before - new) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            dgates[:, :, i] = np.concatenate([dz, dr, dn], axis=2)
            drec = np.concatenate([dz, dr, dn * r], axis=2)
            g["u"] += np.matmul(before.transpose(0, 2, 1), drec)
            dstate = d * (1 - m * (1 - z)) + np.matmul(drec, self.p["u"].transpose(0, 2, 1))
        return g, dgates


def _gates(projected: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Gate inputs and mask of windows over joined word numbers."""
    at = start[:, None] + np.arange(WINDOW)
    mask = (at < end[:, None])
    index = words[np.where(mask, at, 0)] if len(words) else np.zeros(at.shape, np.int64)
    gates = np.stack([projected[0][index], projected[1][index[:, ::-1]]])
    return gates, mask.astype(np.float32), index


def score_windows(net: Network, projected: np.ndarray, words: np.ndarray, lengths: np.ndarray, slab: int = 1024):
    doc, start, end = windows(lengths)
    out = np.empty(len(doc), np.float32)
    for k in range(0, len(doc), slab):
        gates, mask, _ = _gates(projected, words, start[k: k + slab], end[k: k + slab])
        out[k: k + slab] = net.forward(gates, mask)[0]
    return doc, start, end, out


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Fit a network on all rows; the threshold is placed by networks that leave a part of the rows out."""
    rng = np.random.default_rng(seed)
    net = Network()
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        # One class only: its share is the score of every text.
        net.p["wo"][:] = 0
        net.p["bo"][:] = 0
        net.scale, net.shift = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 4.5))
        return net
    index: dict[bytes, int] = {}
    numbers = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    words = np.concatenate(numbers)
    lengths = np.array([len(x) for x in numbers], np.int64)
    # A word for the padding of texts without words.
    vocabulary = list(index) or [b"0"]
    del numbers, index, texts
    bucket, begin, grams = flat_features(vocabulary)
    doc, start, end = windows(lengths)
    ends = np.cumsum(lengths)
    # Parts of the vocabulary are worked on one after another, so that little is held at once.
    slabs = [(k, min(k + 20_000, len(vocabulary))) for k in range(0, len(vocabulary), 20_000)]
    first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])

    def learn(dev: np.ndarray) -> tuple[Network, np.ndarray]:
        """A network from the rows outside ``dev``, and the highest logit of every row."""
        # Before the first round, windows are ranked by the log odds of their words' n-grams.
        odds = np.zeros((2, GRAM_BUCKETS))
        for label in (0, 1):
            counts = np.zeros(len(vocabulary), np.int64)
            for d in np.flatnonzero(~dev & (y == label)).tolist():
                counts[np.unique(words[ends[d] - lengths[d]: ends[d]])] += 1
            for low, high in slabs:
                odds[label] += np.bincount(
                    grams[begin[low]: begin[high]], weights=np.repeat(counts[low: high], np.diff(begin[low: high + 1])),
                    minlength=GRAM_BUCKETS)
            odds[label] = np.log((odds[label] + 0.5) / (counts.sum() + 0.5 * GRAM_BUCKETS))
        gain = np.zeros(len(vocabulary))
        for low, high in slabs:
            first_gram, own = begin[low: high] - begin[low], (odds[1] - odds[0])[grams[begin[low]: begin[high]]]
            some = np.flatnonzero(np.diff(begin[low: high + 1]))
            if len(some):
                gain[low + some] = np.maximum.reduceat(own, first_gram[some])
        top = np.empty(len(doc), np.float32)
        for k in range(0, len(doc), 1024):
            at = start[k: k + 1024, None] + np.arange(WINDOW)
            inside = at < end[k: k + 1024, None]
            strength = gain[words[np.where(inside, at, 0)]] if len(words) else np.zeros(at.shape)
            top[k: k + 1024] = np.sort(np.where(inside, strength, -9), axis=1)[:, -2:].sum(1)

        net = Network()
        slow = {k: np.zeros_like(v) for k, v in net.p.items()}
        fast = {k: np.zeros_like(v) for k, v in net.p.items()}
        step = 0

        def update(name: str, grad: np.ndarray, rate: float) -> None:
            slow[name] += 0.1 * (grad - slow[name])
            fast[name] += 0.01 * (grad * grad - fast[name])
            ahead = (1 - 0.9 ** step), (1 - 0.99 ** step)
            net.p[name] -= rate * (slow[name] / ahead[0]) / (np.sqrt(fast[name] / ahead[1]) + 1e-6)

        def highest(values: np.ndarray) -> np.ndarray:
            order = np.lexsort((values, doc))
            return order[np.concatenate([np.flatnonzero(np.diff(doc[order])), [len(doc) - 1]])]

        # Few rows get more rounds, so that there are enough steps.
        turns = max(rounds, -(-LEAST_STEPS * 128 // (2 * len(y))))
        for turn in range(turns):
            best = highest(top)
            anyone = first + (rng.random(len(first)) * np.bincount(doc)).astype(np.int64)
            chosen = np.concatenate([best[~dev], anyone[~dev & (y == 0)]])
            rng.shuffle(chosen)
            for k in range(0, len(chosen), 128):
                rows = chosen[k: k + 128]
                at = start[rows][:, None] + np.arange(WINDOW)
                mask = at < end[rows][:, None]
                used, inverse = np.unique(
                    words[np.where(mask, at, 0)] if len(words) else np.zeros(at.shape, np.int64), return_inverse=True)
                inverse = inverse.reshape(at.shape)
                spans = [grams[begin[w]: begin[w + 1]] for w in used]
                counts = np.array([len(s) for s in spans])
                joined = np.concatenate(spans)
                belongs = np.repeat(np.arange(len(used)), counts)
                x = np.concatenate([
                    net.p["word"][bucket[used]], _gram_means([(joined, belongs)], net.p["gram"], len(used))], axis=1)
                projected = net.project(x)
                gates = np.stack([projected[0][inverse], projected[1][inverse[:, ::-1]]])
                mask = mask.astype(np.float32)
                logit, memory = net.forward(gates, mask, keep=True)
                truth = y[doc[rows]]
                dlogit = ((_sigmoid(logit) - truth) * np.where(truth > 0, 1.5, 1.0) / len(rows)).astype(np.float32)
                g, dgates = net.gradients(dlogit, mask, memory)
                step += 1
                per_word = np.zeros((2, len(used), 3 * HIDDEN), np.float32)
                np.add.at(per_word[0], inverse.ravel(), dgates[0].reshape(-1, 3 * HIDDEN))
                np.add.at(per_word[1], inverse[:, ::-1].ravel(), dgates[1].reshape(-1, 3 * HIDDEN))
                g["wx"] = np.matmul(x.T[None], per_word)
                g["bx"] = per_word.sum(1, keepdims=True)
                dx = sum(per_word[d] @ net.p["wx"][d].T for d in (0, 1))
                g["word"] = np.zeros_like(net.p["word"])
                np.add.at(g["word"], bucket[used], dx[:, :WIDTH])
                share = dx[:, WIDTH:] / np.maximum(counts, 1)[:, None]
                g["gram"] = np.stack([
                    np.bincount(joined, weights=share[belongs, d], minlength=GRAM_BUCKETS) for d in range(WIDTH)
                ], axis=1).astype(np.float32)
                for name, grad in g.items():
                    update(name, grad, 0.01 if turn < turns - 2 else 0.004)
            # After the first rounds, windows are ranked by the model.
            every = max(1, turns // ROUNDS)
            if turn and (turn + 1) % every == 0 or turn == turns - 1:
                projected = np.empty((2, len(vocabulary), 3 * HIDDEN), np.float32)
                for low, high in slabs:
                    projected[:, low: high] = net.project(net.inputs(word_features(vocabulary[low: high])))
                top = score_windows(net, projected, words, lengths, slab=256)[3]
                del projected
        return net, np.maximum.reduceat(top, first)

    # Each class is dealt evenly over the folds.
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        fold[rows] = np.arange(len(rows)) % FOLDS
    net, peak = learn(np.zeros(len(y), bool))
    if 1 < y.sum() < len(y) - 1:
        for k in range(FOLDS):
            peak[fold == k] = learn(fold == k)[1][fold == k]
    place_threshold(net, peak, y)
    return net


def place_threshold(net: Network, peak: np.ndarray, y: np.ndarray) -> None:
    """Logistic scale of the highest logits, then shifted so that the best cut has score THRESHOLD."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * peak + b)
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * peak * peak).sum() + 1.0, (w * peak).sum()], [(w * peak).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(hess, [((p - y) * peak).sum() + (a - 1.0), (p - y).sum()])
        a, b = a - da, b - db
    a = max(a, 0.05)
    order = np.argsort(-peak, kind="stable")
    hits = np.cumsum(y[order])
    # Twice as much weight on precision: clean documents are to be left alone.
    f_half = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    k = int(np.argmax(f_half))
    cut = (peak[order[k]] + (peak[order[k + 1]] if k + 1 < len(y) else peak[order[k]] - 1)) / 2
    net.scale, net.shift = float(a), float(math.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
) -> Network:
    """A network from at most ``toxic_rows`` and ``clean_rows`` labelled rows, chosen by hash of the id.

    Rows with a null id or label are left out. Only texts and labels reach the network. It is
    trained in a task, so that neither texts nor what training needs take the driver's memory.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    order = F.xxhash64("id")
    chosen = known.where("y = 1").orderBy(order, "id").limit(toxic_rows).union(
        known.where("y = 0").orderBy(order, "id").limit(clean_rows))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).join(
        # At most toxic_rows + clean_rows rows.
        F.broadcast(chosen), "id").select("id", "body", "y")

    def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        truth: list[int] = []
        for frame in frames:
            texts += frame.column(1).to_pylist()
            truth += frame.column(2).to_pylist()
        net = train(texts, truth)
        del texts, truth
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps((net.p, net.scale, net.shift))], pa.binary())], names=["net"])

    learned = rows.repartition(1).sortWithinPartitions("id", "body").mapInArrow(learn, "net binary").collect()
    if not learned:
        return train([], [])
    net = Network()
    net.p, net.scale, net.shift = pickle.loads(learned[0]["net"])
    return net


def score(
    df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """One row per input row: id, carried columns, the text if asked, score, predicted, window_start, n_words.

    ``window_start`` is the first word of the highest window. A null or empty
    text has one empty window. Ids, null ids and repeated rows pass through; an
    empty table gives an empty result. No shuffle.
    """
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in (id_col, *carry)]
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(net))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = cloudpickle.loads(shared.value)
        index: dict[bytes, int] = {}
        index[b"0"] = 0
        projected = np.empty((2, CACHED_WORDS, 3 * HIDDEN), np.float32)
        projected[:, :1] = net.project(net.inputs(word_features([b"0"])))
        for frame in frames:
            for low in range(0, frame.num_rows, 256):
                part = frame.slice(low, 256)
                split = [words_of(t.as_py() or "") for t in part.column(part.num_columns - 1)]
                new = list({w for ws in split for w in ws}.difference(index))
                if len(index) + len(new) > CACHED_WORDS and len(index) > 1:
                    index = {b"0": 0}
                    new = list({w for ws in split for w in ws}.difference(index))
                if len(index) + len(new) > projected.shape[1]:
                    # One slice of documents with more words than are remembered.
                    wider = np.empty((2, len(index) + len(new), 3 * HIDDEN), np.float32)
                    wider[:, : len(index)] = projected[:, : len(index)]
                    projected = wider
                for k in range(0, len(new), 20_000):
                    some = new[k: k + 20_000]
                    at = len(index)
                    projected[:, at: at + len(some)] = net.project(net.inputs(word_features(some)))
                    index.update(zip(some, range(at, at + len(some)), strict=True))
                lengths = np.array([len(ws) for ws in split], np.int64)
                words = np.fromiter((index[w] for ws in split for w in ws), np.int64, int(lengths.sum()))
                doc, start, _, logits = score_windows(net, projected, words, lengths)
                order = np.lexsort((-start, logits, doc))
                best = order[np.concatenate([np.flatnonzero(np.diff(doc[order])), [len(doc) - 1]])]
                scores = _sigmoid(net.scale * logits[best].astype(np.float64) + net.shift)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)),
                     pa.array(start[best] - (np.cumsum(lengths) - lengths)), pa.array(lengths)],
                    names=[*names, "score", "predicted", "window_start", "n_words"],
                )

    body = F.col(text_col).cast("string").alias("body")
    picked = df.select(*[F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(kinds)], body)
    schema = ", ".join([*[f"c{i} {k}" for i, (_, k) in enumerate(kinds)], *(["body string"] if keep_text else [])])
    names = picked.columns if keep_text else picked.columns[:-1]
    out = picked.mapInArrow(run, schema + ", score double, predicted int, window_start long, n_words long")
    kept = [F.col(f"c{i}").alias(c) for i, (c, _) in enumerate(kinds)] + (
        [F.col("body").alias(text_col)] if keep_text else [])
    return out.select(*kept, "score", "predicted", "window_start", "n_words")
