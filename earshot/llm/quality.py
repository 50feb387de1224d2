"""Document quality from text evidence and hierarchical empirical Bayes over sites.

A logistic classifier on counts of a text's characters and words gives each document's evidence.
Grouped sums of it over hosts, and over paths inside hosts, give posteriors of either level: a
path's mean is drawn to its host's and a host's to the global one, with prior weights estimated
from the spread of the groups (method of moments). A document's own evidence is left out of its
groups. The result combines the document's odds with those of its path.

Only group sums are shuffled, with partial sums, so a host with a third of all rows is a few rows
per task. Documents never move: group statistics are sent to them if they are few
(``MAX_BROADCAST_GROUPS``); beyond that they are joined, with large groups split by a salt.

Odd input: null and empty texts get the classifier's score of an empty text. Null hosts and paths
are groups of their own. Without labels of both classes, nothing is known and all is kept. Labels
of unknown documents, null labels and repeated labels (the least counts) do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

#: Labelled documents that the classifier is fitted on, at most; those with the least hash of the id.
MAX_TRAIN_DOCS = 20_000
#: Groups whose statistics are sent to every worker (about 60 bytes each), at most.
MAX_BROADCAST_GROUPS = 100_000
#: Parts of a group in the join that is used beyond that.
SALTS = 32
#: Documents with less than this probability of being good are rejected.
THRESHOLD = 0.5

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = _LETTERS + b"0123456789 \t\n\r\x0b\x0c.,;:'\"-()?"
N_FEATURES = 9


def features(text: bytes) -> list[float]:
    """Shares and logarithms that tell prose from junk; all are bounded."""
    n = len(text)
    ws = text.split()
    k = len(ws)
    if not k:
        return [0.0] * N_FEATURES
    letters = n - len(text.translate(None, _LETTERS))
    upper = n - len(text.translate(None, _UPPER))
    odd = len(text.translate(None, _PLAIN))
    distinct = len(set(ws))
    repeats = sum(map(bytes.__eq__, ws, ws[1:]))
    return [
        1.0,
        letters / n,
        upper / max(letters, 1),
        odd / n,
        min(odd / k, 3.0),
        distinct / k,
        repeats / k,
        np.log1p(k) / 10,
        min(n / k, 40.0) / 10,
    ]


def _features(texts: list[bytes]) -> list[pa.Array]:
    return [C.list_array([np.array(features(t)) for t in texts], pa.float64())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray | None:
    """Weights of the classifier (bias last), or None without both classes."""
    C.prepare(docs.sparkSession)
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id IS NOT NULL AND y IN (0, 1)")
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MAX_TRAIN_DOCS)
    )
    # The sample is bounded, and so is what is broadcast and what comes to the driver.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    got = C.map_texts(rows, "text", _features, "x array<double>", ["id", "y"]).dropDuplicates(["id"]).limit(MAX_TRAIN_DOCS).orderBy("id").collect()
    y = np.array([r.y for r in got], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return logistic(np.array([r.x for r in got]), y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised columns; weights for raw columns."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge * len(x) ** 0.5)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def _scorer(weights: np.ndarray | None):
    def score(texts: list[bytes]) -> list[pa.Array]:
        if weights is None:
            return [pa.array([0.5] * len(texts), pa.float64())]
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return [pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -12, 12))))]

    return score


def evidence(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``evidence``: the classifier's probability that a document is good."""
    return C.map_texts(docs, text_col, _scorer(weights), "evidence double", keep)


def _prior_weight(groups: DataFrame, n: str, total: str, mean: str) -> DataFrame:
    """One row: the weight, in documents, of the prior mean over ``groups``.

    Method of moments: groups that differ no more than chance get a large weight.
    """
    rate, centre = F.col(total) / F.col(n), F.col(mean)
    spread = F.sum(F.col(n) * (rate - centre) ** 2)
    noise = F.sum(centre * (1 - centre))
    between = (spread - noise) / F.sum(n)
    return groups.agg((F.avg(centre * (1 - centre)) / F.greatest(between, F.lit(1e-6))).alias("k")).select(
        F.least(F.greatest(F.coalesce("k", F.lit(100.0)), F.lit(2.0)), F.lit(10_000.0)).alias("k")
    )


def site_statistics(scored: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """One row per (host, path): sums of the path and its host, prior weights and the global mean."""
    paths = scored.groupBy(F.col(host_col).alias("host"), F.col(path_col).alias("path")).agg(F.count(F.lit(1)).alias("n_path"), F.sum("evidence").alias("s_path"))
    paths = paths.checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    whole = hosts.agg((F.sum("s_host") / F.sum("n_host")).alias("g"))
    ranked = hosts.join(F.broadcast(whole))  # one row
    k_host = _prior_weight(ranked, "n_host", "s_host", "g").withColumnRenamed("k", "k_host")
    ranked = ranked.join(F.broadcast(k_host))  # one row
    shrunk = (F.col("s_host") + F.col("k_host") * F.col("g")) / (F.col("n_host") + F.col("k_host"))
    joined = paths.join(ranked.withColumn("m_host", shrunk), paths["host"].eqNullSafe(ranked["host"])).drop(ranked["host"])
    k_path = _prior_weight(joined, "n_path", "s_path", "m_host").withColumnRenamed("k", "k_path")
    return joined.join(F.broadcast(k_path)).drop("m_host")  # one row


def posteriors(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds evidence, host_mean, path_mean, posterior and accepted to the documents."""
    C.prepare(docs.sparkSession)
    names = docs.columns if keep is None else keep
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    stats = site_statistics(evidence(row, weights, "text", ["host", "path"]), "host", "path").checkpoint()
    scored = evidence(row, weights, "text", ["row", "host", "path"])
    if stats.count() <= MAX_BROADCAST_GROUPS:
        joined = scored.join(F.broadcast(stats.withColumnsRenamed({"host": "h", "path": "p"})), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    else:
        salted = stats.withColumnsRenamed({"host": "h", "path": "p"}).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("salt") == F.col("s")))
    e = F.col("evidence")
    # Each mean without the document itself.
    host_mean = (F.col("s_host") - e + F.col("k_host") * F.col("g")) / (F.col("n_host") - 1 + F.col("k_host"))
    path_mean = (F.col("s_path") - e + F.col("k_path") * F.col("host_mean")) / (F.col("n_path") - 1 + F.col("k_path"))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    odds = logit(e) + logit(F.col("path_mean")) - logit(F.col("g"))
    post = F.lit(0.5) if weights is None else 1 / (1 + F.exp(-odds))
    done = joined.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean).withColumn("posterior", post)
    return done.select("row.*", "evidence", "host_mean", "path_mean", "posterior", (F.col("posterior") >= threshold).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    weights = fit(docs, labels, id_col, text_col)
    row = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"))
    return posteriors(row, weights, "_text", "_host", "_path", keep=["_row"]).where("accepted").select("_row.*")
