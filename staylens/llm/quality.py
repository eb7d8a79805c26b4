"""Quality by document evidence and hierarchical empirical Bayes over hosts and paths (operator 3).

A document's evidence is the log likelihood ratio of its binned text features,
estimated from labelled rows by grouped counts. Hosts and paths below them have
posterior shares of good documents: a path's share is shrunk toward its host's, a
host's toward the global one, each with a strength estimated from the spread
between groups. A document's score joins its evidence with the posterior of its
path from which its own contribution has been taken out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from staylens.llm.common import text_or_empty, written

BINS = 16
#: Least score of a kept document; below one half, since losing a clean document costs more.
KEEP = 0.3
#: Features overlap, so their summed evidence is scaled down.
TEMPER = 0.6
MARKS = "%&$#*|~^<>{}[]=_\\@+"


def _removed(text: Column, pattern_chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, pattern_chars, ""))


def features(text: Column) -> Column:
    """Shares in [0, 1] that tell prose from noise."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 20)
    spaces = _removed(text, " \n\t")
    return F.array(
        _removed(text, MARKS) / n,
        _removed(text, letters) / n,
        _removed(text, "0123456789") / n,
        _removed(text, "!?") / n,
        F.least(n / (spaces + 1) / 40, F.lit(1.0)),
        1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        F.least(_removed(text, ".,;:") / n * 4, F.lit(1.0)),
        F.least(F.log10(n) / 6, F.lit(1.0)),
        # Words that repeat the word before.
        F.least(2 * F.regexp_count(text, F.lit(r"(?<!\S)(\S++) \1(?!\S)")) / (spaces + 1), F.lit(1.0)),
    )


N_FEATURES = 9


def _bins(shares: Column) -> Column:
    """Finer bins for small shares."""
    return F.transform(shares, lambda x: F.least(F.floor(F.sqrt(x) * BINS), F.lit(BINS - 1)).cast("int"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def evidence_table(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[list[float], float]:
    """Log likelihood ratio (good : bad) of every bin of every feature, and the log odds of good rows.

    Grouped counts of fixed size come to the driver: features x bins x labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = (
        rows.select("id", "bins").join(known, "id")
        .select("y", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "y").count().collect()
    )
    seen = {(r["feature"], r["bin"], r["y"]): r["count"] for r in counts}
    total = [sum(n for (f, _, y), n in seen.items() if f == 0 and y == k) for k in (0, 1)]
    table = []
    for f in range(N_FEATURES):
        for b in range(BINS):
            rate = [(seen.get((f, b, k), 0) + 0.5) / (total[k] + 0.5 * BINS) for k in (0, 1)]
            table.append(math.log(rate[1] / rate[0]) if all(total) else 0.0)
    return table, math.log((total[1] + 1) / (total[0] + 1))


def _strength(groups: DataFrame, good: str, n: str, mean: Column) -> Column:
    """Prior strength by moments: how many documents the parent counts for."""
    share = F.col(good) / F.col(n)
    spread = F.sum(F.col(n) * (share - mean) ** 2) / F.sum(n)
    inside = F.sum(mean * (1 - mean)) / F.sum(n)
    between = F.greatest(spread - inside, F.lit(1e-6))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / between - 1, F.lit(2.0)), F.lit(1e4))


def score(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str | None = "lang", label_col: str = "quality", keep: float = KEEP,
) -> DataFrame:
    """One row per input row: id, host, path, evidence, host_quality, path_quality, score, kept.

    A null text counts as empty, a null host or path as the empty string. A
    null id has no label. Repeated rows are scored alike; labels of a repeated
    id all count. Without labels of both classes there is no evidence. An empty
    table gives an empty result; other columns are ignored. Only features and
    grouped sums are shuffled, never texts; a host of any size is pre-aggregated.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = written(df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"), _bins(features(text_or_empty(text_col))).alias("bins"),
    ), "quality-features")
    table, prior = evidence_table(rows, labels, id_col, label_col)
    weights = F.array(*[F.lit(float(w)) for w in table])
    rows = rows.withColumn("evidence", F.lit(TEMPER) * F.aggregate(
        F.transform("bins", lambda b, f: F.get(weights, f * BINS + b)), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("soft", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior)))))
    paths = written(rows.groupBy("host", "path").agg(F.sum("soft").alias("good"), F.count("*").alias("n")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "quality-hosts")
    # A few numbers: the global share, and the strengths of the two levels.
    mean = hosts.agg((F.sum("good") + 1) / (F.sum("n") + 2)).collect()[0][0]
    mean = 0.5 if mean is None else float(mean)
    of_host = hosts.agg(_strength(hosts, "good", "n", F.lit(mean))).collect()[0][0] or 2.0
    hosts = hosts.select("host", ((F.col("good") + of_host * mean) / (F.col("n") + of_host)).alias("host_quality"))
    below = paths.join(hosts, "host")
    of_path = below.agg(_strength(below, "good", "n", F.col("host_quality"))).collect()[0][0] or 2.0
    out = rows.join(below, ["host", "path"])
    others = (F.col("good") - F.col("soft") + of_path * F.col("host_quality")) / (F.col("n") - 1 + of_path)
    return out.select(
        F.col("id").alias(id_col), "host", "path", "evidence", "host_quality", others.alias("path_quality"),
        (1 / (1 + F.exp(-(F.col("evidence") + _logit(others))))).alias("score"),
    ).withColumn("kept", F.col("score") >= keep)
