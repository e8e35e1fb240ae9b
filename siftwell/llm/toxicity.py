"""Toxicity as severity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - cut_k) with one weight vector for all ordered cuts; the expected severity is the sum of
these. Features are words and word beginnings (hashes), of which the fit keeps the ``markers`` that stand out among
toxic documents; a document's value for a marker is log(1 + occurrences).

The labels are 0 and 1 only. How clearly a toxic document is one is judged by those it was not fitted with: the labelled
documents are parted in ``FOLDS``, each is scored by a model of the two classes, markers included, fitted on the others, and
the toxic ones get grade 1, 2 or 3 by thirds of these scores; documents that are not toxic have grade 0. From P(grade > 0) =
``limit`` on a document is toxic; unless it is given, it is where P(grade > 0) of the graded model, fitted in the same way on
the other folds, parts the labels best (by F1), in the middle of the gap there. ``Model.held_out`` tells how each fold came out at the limit of the others.
The fit uses at most ``sample``
labelled rows (the first by hash of the id); every row of the input is scored.

Nulls, ties, repeats: a null text has no features; label rows with a null in a column that counts are no examples;
of several labels for one document the highest counts; scores that tie have one grade, and one at the limit is toxic;
repeated rows give a row each; with no example of both kinds nothing is toxic (severity 0); an empty table gives no rows;
other columns are ignored. A very long text counts whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shards import polynomial
from .textbytes import LETTERS, Words, mixed, word_hashes

#: Word beginnings of so many bytes are features beside whole words.
PREFIXES = (5, 6, 7, 8)
#: Parts of the labelled documents, and grades of toxic ones.
FOLDS, GRADES = 4, 3
#: Everything in ASCII but letters and digits parts words here.
SEPARATE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all words and beginnings, their documents, and the number of documents."""
    w = Words(column, lower=True, space=SEPARATE)
    doc = np.repeat(np.arange(w.docs), w.counts())
    found, owner = [word_hashes(w)], [doc]
    for n in PREFIXES:
        h = mixed(polynomial(LETTERS[w.data], n, 0x9E3779B97F4A7C15 + 2 * n))
        long = np.flatnonzero(w.end - w.begin >= n)
        found.append(h[w.begin[long]])
        owner.append(doc[long])
    return np.concatenate(found), np.concatenate(owner), w.docs


class Model:
    """Markers (sorted hashes), their weights, the ordered cuts, and the probability from which on a text is toxic."""

    def __init__(self, markers: np.ndarray, weights: np.ndarray, cuts: np.ndarray, limit: float = 0.5, held_out: tuple[int, int, int, int] | None = None):
        self.markers, self.weights, self.cuts, self.limit, self.held_out = markers, weights, cuts, limit, held_out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and P(grade > 0) of each text."""
        h, doc, docs = features(column)
        z = np.zeros(docs)
        if not len(self.cuts):
            return z, z
        if len(self.markers):
            at = np.minimum(np.searchsorted(self.markers, h), len(self.markers) - 1)
            hit = self.markers[at] == h
            pairs, n = np.unique(doc[hit] * len(self.markers) + at[hit], return_counts=True)
            z = np.bincount(pairs // len(self.markers), np.log1p(n) * self.weights[pairs % len(self.markers)], docs)
        p = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -40, 40)))
        return p.sum(1), p[:, 0]


NONE = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


def standing_out(bad: np.ndarray, good: np.ndarray, n1: int, n0: int, markers: int, least_z: float) -> np.ndarray:
    """Places of the features whose share among toxic documents most exceeds that among others, by the two-sample z."""
    share = (bad + good) / (n1 + n0)
    z = (bad / n1 - good / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    top = np.argsort(-z, kind="stable")[:markers]
    return np.sort(top[z[top] >= least_z])


def out_of_fold(x: np.ndarray, grade: np.ndarray, rounds: int, fold: np.ndarray | None = None, chosen: list[np.ndarray] | None = None, top: int = 1) -> np.ndarray:
    """Logit of P(grade > 0) of each row by a model fitted on the folds that it is not in; ``chosen``: the columns of each fold's markers."""
    fold, out = np.arange(len(x)) % FOLDS if fold is None else fold, np.zeros(len(x))
    for f in range(FOLDS):
        rest, own = fold != f, slice(None) if chosen is None else chosen[f]
        if 0 < (grade[rest] > 0).sum() < rest.sum():
            w, cut = ordinal(x[rest][:, own], grade[rest].astype(int), top, rounds)
            out[~rest] = x[~rest][:, own] @ w - cut[0]
    return out


def parted(score: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> tuple[int, int, int, int]:
    """Toxic documents found and all, others marked and all, each fold at the limit that the others learn."""
    p, marked = 1 / (1 + np.exp(-np.clip(score, -40, 40))), np.zeros(len(score), bool)
    for f in np.unique(fold):
        rest = fold != f
        if toxic[rest].any():
            marked[~rest] = p[~rest] >= between(score[rest], best_limit(score[rest], toxic[rest]))
    return int((marked & toxic).sum()), int(toxic.sum()), int((marked & ~toxic).sum()), int((~toxic).sum())


def best_limit(score: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that parts the labels best: the highest F1, of equal ones the highest limit."""
    order = np.argsort(-score, kind="stable")
    found = np.cumsum(toxic[order])
    f1 = 2 * found / (np.arange(1, len(order) + 1) + toxic.sum())
    last = np.concatenate([score[order][1:] != score[order][:-1], [True]])  # equal scores go together
    return float(1 / (1 + np.exp(-score[order][np.argmax(np.where(last, f1, -1.0))])))


def between(score: np.ndarray, limit: float) -> float:
    """The middle, on the scale of scores, between the last score at or above the limit and the first below: what it parts stays
    parted, and a model that scores a little otherwise than those of the folds has room on both sides."""
    p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    above, below = score[p >= limit - 1e-12], score[p < limit - 1e-12]
    if not len(above) or not len(below):
        return limit
    return float(1 / (1 + np.exp(-np.clip((above.min() + below.max()) / 2, -40, 40))))


def grades(score: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for documents that are not toxic, else 1 to ``GRADES`` by equal shares of the toxic ones' out-of-fold scores."""
    steps = np.quantile(score[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + (score[:, None] > steps[None, :]).sum(1), 0)


def fit(markers: np.ndarray, counts: np.ndarray, toxic: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray], rounds: int = 500) -> Model:
    """``counts``: occurrences of each marker in each labelled document; ``chosen``: columns of the markers that each fold's
    model may use, last those of the model itself."""
    x, own = np.log1p(counts), chosen[-1]
    grade = grades(out_of_fold(x, toxic, 150, fold, chosen), toxic)
    score = out_of_fold(x, grade, rounds, fold, chosen, GRADES)
    return Model(markers[own], *ordinal(x[:, own], grade, GRADES, rounds), between(score, best_limit(score, toxic)), parted(score, toxic, fold))


def loss(p: np.ndarray, x: np.ndarray, grade: np.ndarray, top: int, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Penalised mean -log likelihood and its gradient. ``p``: weights, the first cut, logarithms of the gaps between cuts."""
    rows, m = np.arange(len(x)), x.shape[1]
    w, gaps = p[:m], np.exp(np.clip(p[m + 1 :], -4, 3))
    cuts = p[m] + np.concatenate([[0], np.cumsum(gaps)])
    f = 1 / (1 + np.exp(np.clip(cuts[None, :] - (x @ w)[:, None], -40, 40)))  # P(grade > k)
    f = np.concatenate([np.ones((len(x), 1)), f, np.zeros((len(x), 1))], axis=1)
    like = np.maximum(f[rows, grade] - f[rows, grade + 1], 1e-12)
    slope = f * (1 - f)
    up, down = slope[rows, grade] / like, slope[rows, grade + 1] / like
    g_cut = np.array([up[grade == k + 1].sum() - down[grade == k].sum() for k in range(top)]) / len(x)
    g = np.concatenate([-(x.T @ (up - down)) / len(x) + ridge * w, [g_cut.sum()], [gaps[k] * g_cut[k + 1 :].sum() for k in range(top - 1)]])
    return float(-np.log(like).mean() + ridge * (w @ w) / 2), g


def ordinal(x: np.ndarray, grade: np.ndarray, top: int, rounds: int, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the cumulative logit model, by Adam on the penalised likelihood; gaps between cuts stay positive."""
    p = np.zeros(x.shape[1] + top)
    p[x.shape[1]] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = loss(p, x, grade, top, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    gaps = np.exp(np.clip(p[x.shape[1] + 1 :], -4, 3))
    return p[: x.shape[1]], p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])


def trained(docs: DataFrame, labels: DataFrame, sample: int = 12_000, markers: int = 256, least_z: float = 6.0, least_docs: int = 5, candidates: int = 100_000) -> Model:
    """The model of ``labels(doc_id, toxic)`` over ``docs``.

    Of the ``sample`` documents at most that are used, the driver gets the commonest ``candidates`` features of toxic
    ones, how many documents have each, and the counts of the ``markers`` chosen.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    chosen = common.bounded(known, total, sample, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    used = common.table(rows.join(F.broadcast(chosen), "doc_id").withColumn("fold", fold), "toxicity-sample")

    def in_documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes that a text has, once each; their documents; labels."""
        h, doc, n = features(batch.column("text"))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
        return h[new], doc[new], np.asarray(batch.column("toxic")).astype(bool)

    def common_ones(batches):
        for b in common.pieces(batches, "text"):
            names, n = np.unique(in_documents(b)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    many = used.filter("toxic = 1").mapInArrow(common_ones, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_docs)
    names = np.sort(np.asarray(many.orderBy(F.desc("n"), "h").limit(candidates).toArrow()["h"].combine_chunks()).view(np.uint64))
    if not len(names):
        return NONE

    def frequencies(batches):
        out = np.zeros((FOLDS, 2, len(names) + 1), np.int64)  # the last place: documents
        for b in common.pieces(batches, "text"):
            h, doc, toxic = in_documents(b)
            part = np.asarray(b.column("fold"))
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            hit = names[at] == h
            for f in range(FOLDS):
                for k in (0, 1):
                    some = hit & (toxic[doc] == k) & (part[doc] == f)
                    out[f, k, :-1] += np.bincount(at[some], minlength=len(names))
                    out[f, k, -1] += ((toxic == k) & (part == f)).sum()
        for f in range(FOLDS):
            some = np.flatnonzero(out[f].any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), f)), pa.array(out[f, 0, some]), pa.array(out[f, 1, some])], ["at", "fold", "n0", "n1"])

    totals = used.mapInArrow(frequencies, "at long, fold long, n0 long, n1 long").groupBy("at", "fold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # a row a candidate and fold
    sums = np.zeros((FOLDS, 2, len(names) + 1), np.int64)
    for k in (0, 1):
        sums[np.asarray(totals["fold"]), k, np.asarray(totals["at"])] = np.asarray(totals[f"n{k}"])

    def best_of(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Places of the markers of these documents; features that are too rare among their toxic ones are none."""
        if not good[-1] or not bad[-1]:
            return np.zeros(0, np.int64)
        return standing_out(np.where(bad[:-1] >= least_docs, bad[:-1], 0), good[:-1], bad[-1], good[-1], markers, least_z)

    whole = sums.sum(0)
    places = [*(best_of(*(whole - sums[f])) for f in range(FOLDS)), best_of(*whole)]
    if not len(places[-1]):
        return NONE
    every = np.unique(np.concatenate(places))
    best, chosen = names[every], [np.searchsorted(every, p) for p in places]

    def occurrences(batches):
        for b in common.pieces(batches, "text"):
            h, doc, n = features(b.column("text"))
            at = np.minimum(np.searchsorted(best, h), len(best) - 1)
            hit = best[at] == h
            x = np.bincount(doc[hit] * len(best) + at[hit], minlength=n * len(best)).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("fold"), pa.array([r.tobytes() for r in np.minimum(x, 65535).astype(np.uint16)], pa.binary())], ["doc_id", "toxic", "fold", "x"])

    got = used.mapInArrow(occurrences, "doc_id long, toxic int, fold int, x binary").withColumn("h", F.xxhash64("doc_id")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint16).reshape(-1, len(best)).astype(float)
    return fit(best, x, np.asarray(got["toxic"]).astype(bool), np.asarray(got["fold"]), chosen)


def severity(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """``doc_id, severity, p_toxic`` of every row; with ``keep`` the columns of ``docs`` and the two last as ``toxicity`` (or a name like it)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred markers
    name = common.unused(docs, "toxicity")

    def run(batches):
        for b in common.pieces(batches, "text"):
            s, p = shared.value.score(b.column("text"))
            both = pa.StructArray.from_arrays([pa.array(s), pa.array(p)], ["severity", "p_toxic"])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), both], [*b.schema.names, name])

    rows = docs.withColumn("text", F.col("text").cast("string")) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, found)]))
    return out if keep else out.select("doc_id", f"{name}.*")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose P(grade > 0) is below ``limit``."""
    model = trained(docs, labels, **options)
    out = severity(docs, model, keep=True)
    return out.filter(F.col(out.columns[-1])["p_toxic"] < (model.limit if limit is None else limit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def scored(docs: DataFrame, labels: DataFrame, sample: int = 12_000, limit: float | None = None) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` of every row of ``docs``; toxic: P(grade > 0) of ``limit`` or more."""
    model = trained(docs, labels, sample)
    return severity(docs, model).withColumn("toxic", F.col("p_toxic") >= (model.limit if limit is None else limit))
