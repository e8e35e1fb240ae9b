"""Quality classifier from weak labels.

Heuristic labellers vote low (-1), high (1) or abstain (0) on each text. Expectation maximisation over the counts of
vote patterns of all documents estimates, without labels, how each labeller votes on low and on high quality (its
accuracy, which ``labellers`` gives), and gives each pattern its posterior. The posteriors train a linear scorer on hashed
features on at most ``sample`` documents (the first by hash of the id); it scores every document.

Texts are measured once: votes and features are written as sparse rows and all later steps read these. What leaves the
executors: a count for each vote pattern (3 to the number of labellers at most) and the sample.

Nulls, ties, repeats: a null text is empty (all labellers that need words abstain; low quality by lack of words);
repeated rows give a row each; a document whose score is exactly the limit is kept; an empty table gives no rows;
other columns are ignored. A very long text is measured whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textbytes import Words, mixed, word_hashes

WIDTH = 1024
#: Shapes: upper case A, lower case and all beyond ASCII a, digits 0, the rest itself.
SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
ODD = np.isin(np.arange(256), list(b"#$%&*|~^<>{}[]\\=_@+"))
#: Names of the labellers, in the order of the votes.
LABELLERS = ("plain_words", "repeats_words", "odd_signs", "capitals", "shouts", "same_words", "sentences", "word_lengths", "function_words")


def shares(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and for each text the measures that the labellers use (columns as LABELLERS)."""
    w = Words(column)
    n = w.counts()
    doc = np.repeat(np.arange(w.docs), n)
    per = np.maximum(n, 1)
    if not len(w.begin):
        return w, np.zeros((w.docs, len(LABELLERS)))
    h = word_hashes(w)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
    total = lambda flags: np.bincount(doc, np.add.reduceat(flags[w.data].astype(np.int64), w.begin), w.docs)
    size = np.bincount(doc, w.end - w.begin, w.docs)
    byte = np.arange(256)
    upper, letters = total((byte >= 65) & (byte <= 90)), total(((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128))
    distinct = np.bincount(_distinct(doc, h), minlength=w.docs)
    last = w.data[w.end - 1]
    ends = np.bincount(doc, np.isin(last, list(b".!?")), w.docs)
    short = np.bincount(doc, (w.end - w.begin) <= 3, w.docs)
    return w, np.stack([n, np.bincount(doc, again, w.docs) / per, total(ODD) / np.maximum(size, 1), upper / np.maximum(letters, 1), total(byte == 33) / per, distinct / per, ends / per, size / per, short / per], axis=1)


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The document of each distinct (document, word)."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    return d[np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])]


def votes(m: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 of each labeller for each row of measures."""
    n, again, odd, upper, shout, distinct, ends, length, short = m.T
    some = n >= 5
    out = np.zeros(m.shape, np.int8)

    def vote(k: int, low: np.ndarray, high: np.ndarray) -> None:
        out[:, k] = np.where(low, -1, np.where(high, 1, 0))

    no = np.zeros(len(m), bool)  # signs of junk say nothing where they are missing
    vote(0, n == 0, (n > 0) & (odd < 0.005) & (upper < 0.35) & (again < 0.03) & (shout < 0.02))
    vote(1, some & (again > 0.2), no)
    vote(2, some & (odd > 0.03), no)
    vote(3, some & (upper > 0.4), no)
    vote(4, some & (shout > 0.3), no)
    vote(5, (n >= 40) & (distinct < 0.2), (n >= 40) & (distinct > 0.5) & (odd < 0.005))
    vote(6, (n >= 40) & ((ends < 0.01) | (ends > 0.6)), some & (ends > 0.02) & (ends < 0.4) & (upper < 0.2))
    vote(7, some & ((length < 2.5) | (length > 14)), some & (length > 3.5) & (length < 9) & (again < 0.03))
    vote(8, (n >= 30) & (short < 0.03), some & (short > 0.12) & (odd < 0.005))
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation, begun with doubt about every text that has a low vote.

    Gives the posterior of high quality for each vote pattern; the share of low and high quality; and how often each
    labeller votes low, not, high on each: ``[quality, vote, labeller]``. All are smoothed by one count.
    """
    post = np.where((patterns < 0).any(1), 0.1, 0.9)
    cells = np.stack([patterns == v for v in (-1, 0, 1)]).astype(float)
    for _ in range(rounds):
        weight = counts * np.stack([1 - post, post])
        whole = weight.sum(1)
        prior = (whole + 1) / (counts.sum() + 2)
        rate = (np.einsum("cn,vnl->cvl", weight, cells) + 1) / (whole[:, None, None] + 3)
        like = np.log(prior)[:, None] + np.einsum("vnl,cvl->cn", cells, np.log(rate))
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
    return post, prior, rate


def accuracies(prior: np.ndarray, rate: np.ndarray) -> list[tuple[str, float, float]]:
    """Name, share of documents voted on, and share of right votes among these, of each labeller by the model."""
    voted = (prior[:, None] * (rate[:, 0] + rate[:, 2])).sum(0)
    right = prior[0] * rate[0, 0] + prior[1] * rate[1, 2]
    return [(n, float(v), float(r / v)) for n, v, r in zip(LABELLERS, voted, right)]


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text as ``document, slot, value``: word shapes and repeated neighbours as shares of its words."""
    n = w.counts()
    if not len(w.begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32)
    doc = np.repeat(np.arange(w.docs), n)
    shape = SHAPE[w.data]
    fresh = np.concatenate([[True], shape[1:] != shape[:-1]])
    starts = np.zeros(len(shape), bool)
    starts[w.begin] = True
    value = np.where(fresh | starts, shape.astype(np.uint64) + np.uint64(1), np.uint64(0))
    with np.errstate(over="ignore"):
        rank = np.cumsum(value > 0)
        place = (rank - np.repeat(rank[w.begin], w.end - w.begin + 1)[: len(rank)]) % 61
        code = mixed(np.add.reduceat(value * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), w.begin))
    same = np.concatenate([[False], (doc[1:] == doc[:-1])]) & np.concatenate([[False], np.diff(word_hashes(w).view(np.int64)) == 0])
    both = np.concatenate([code % np.uint64(WIDTH - 2), np.where(same, WIDTH - 2, WIDTH - 1).astype(np.uint64)]).astype(np.int64)
    at, many = np.unique(np.concatenate([doc, doc]) * WIDTH + both, return_counts=True)
    return at // WIDTH, (at % WIDTH).astype(np.uint16), np.log1p(many / n[at // WIDTH] * 100).astype(np.float32)


def linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, by Adam; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    p = np.zeros(x.shape[1])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        f = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (f - y) / len(x) + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p


class Graded:
    """The votes and features of all rows of ``docs``, and what was fitted on them."""

    def __init__(self, docs: DataFrame, sample: int = 4_000):
        self.spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def measure(batches):
            for b in common.pieces(batches, "text"):
                w, m = shares(b.column("text"))
                v = votes(m)
                doc, slot, value = hashed(w)
                cut = np.searchsorted(doc, np.arange(w.docs + 1))
                each = list(zip(cut.tolist(), cut[1:].tolist()))
                columns = [pa.array(x, pa.binary()) for x in ([r.tobytes() for r in v], [slot[i:j].tobytes() for i, j in each], [value[i:j].tobytes() for i, j in each])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "votes", "slots", "values"])

        self.seen = common.table(rows.mapInArrow(measure, "doc_id long, votes binary, slots binary, values binary"), "votes")
        counted = self.seen.groupBy("votes").agg(F.count("*").alias("n")).toArrow().sort_by("votes")
        self.patterns, n = counted["votes"].to_pylist(), np.asarray(counted["n"]).astype(float)
        if not self.patterns:
            return
        self.post, self.prior, self.rate = estimate(np.array([np.frombuffer(p, np.int8) for p in self.patterns]), n)
        of = dict(zip(self.patterns, self.post.tolist()))
        fitted = common.bounded(self.seen, int(n.sum()), sample, "doc_id", "slots").withColumn("h", F.xxhash64("doc_id", "slots")).toArrow().sort_by("h")
        self.weights = np.zeros(WIDTH + 1) if not fitted.num_rows else linear(dense(fitted["slots"].to_pylist(), fitted["values"].to_pylist()), np.array([of[v] for v in fitted["votes"].to_pylist()]))

    def labellers(self) -> DataFrame:
        """``labeller, voted, accuracy``: share of documents it votes on, and share of right votes by the model."""
        return self.spark.createDataFrame(accuracies(self.prior, self.rate) if self.patterns else [], "labeller string, voted double, accuracy double")

    def rows(self, limit: float = 0.5) -> DataFrame:
        """``doc_id, votes, weak_label, score, keep``: votes in the order of LABELLERS, posterior, scorer, decision."""
        if not self.patterns:
            return self.spark.createDataFrame([], "doc_id long, votes array<int>, weak_label double, score double, keep boolean")
        shared = self.spark.sparkContext.broadcast((self.weights, dict(zip(self.patterns, self.post.tolist()))))

        def score(batches):
            w, known = shared.value
            for b in common.pieces(batches, "slots"):
                v = b.column("votes").to_pylist()
                slot, value = (np.frombuffer(b"".join(b.column(c).to_pylist()), k) for c, k in (("slots", np.uint16), ("values", np.float32)))
                doc = np.repeat(np.arange(b.num_rows), common.lengths(b.column("slots")) // 2)
                z = np.bincount(doc, value * w[:-1][slot], b.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([np.frombuffer(x, np.int8).tolist() for x in v], pa.list_(pa.int32())), pa.array([known[x] for x in v]), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                    ["doc_id", "votes", "weak_label", "score"],
                )

        out = self.seen.mapInArrow(score, "doc_id long, votes array<int>, weak_label double, score double")
        return out.withColumn("keep", F.col("score") >= limit)


def dense(slots: list[bytes], values: list[bytes]) -> np.ndarray:
    out = np.zeros((len(slots), WIDTH), np.float32)
    for row, s, v in zip(out, slots, values):
        row[np.frombuffer(s, np.uint16)] = np.frombuffer(v, np.float32)
    return out


def graded(docs: DataFrame, sample: int = 4_000, limit: float = 0.5) -> DataFrame:
    """``doc_id, votes, weak_label, score, keep`` of every row, see ``Graded.rows``."""
    return Graded(docs, sample).rows(limit)
