"""Language ID by unigram pieces with all segmentations summed.

The vocabulary is a fixed public one; for each language the probabilities of its pieces are estimated by expectation
maximisation. A text's likelihood is the product over its words (runs of letters with their marks, lower-cased, with the
sign of a word's beginning) of the sum over all ways to cut the word into pieces, by the forward algorithm: piece by piece
position, for all words of a batch at once, with a window that moves along the words and is rescaled on its way, so a word
of any length is summed whole. All pieces of letters of the vocabulary count. A character that no piece covers is a piece
of its own with a small probability.

About ``sample`` training documents are used, the same number of each language where there are enough (chosen by hash of
the id), and of their words the ``words`` commonest of each language, up to ``LEARNED`` characters. Prediction sees the
text only.

Nulls, ties, repeats: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing could
be learned; of languages that tie the first in order is taken; repeated rows give a row each; an empty table gives no
rows; other columns are ignored. A null ``doc_id`` is not held out and not learned from. A very long text is scored whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MARK = "▁"
UNKNOWN = 1e-7
#: Words beyond it teach nothing about pieces.
LEARNED = 64
#: Cells of a matrix of characters that are worked on at once.
CELLS = 1 << 19


def words_of(text: str) -> list[str]:
    """Marked lower-case words."""
    return [MARK + w for w in LETTERS.findall(text.lower())]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as a matrix, padded with 0, and lengths."""
    a = np.array(words)
    m = np.ascontiguousarray(a).view(np.uint32).reshape(len(words), -1)
    return m, (m != 0).sum(1)


def alike(lengths: np.ndarray):
    """Places of words of alike lengths, so many at a time that their matrix has ``CELLS`` cells (one word at least)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # as many words as the longest among them allows; lengths grow along the order
        stop = at + max(1, int(np.searchsorted(lengths[order[at:]] * np.arange(1, len(order) - at + 1), CELLS, "right")))
        stop = min(stop, at + max(1, int(np.searchsorted(lengths[order[at:]], 1.3 * lengths[order[at]] + 2, "right"))))
        yield order[at:stop]
        at = stop


class Pieces:
    """Pieces of letters of a SentencePiece model, looked up by hash."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.names = sorted(p for p in names if p.lower() == p and regex.fullmatch(MARK + r"?[\p{L}\p{M}]+|" + MARK, p))
        self.longest = max(map(len, self.names), default=1)
        own = np.zeros(len(self.names), np.uint64)
        if self.names:
            m, n = code_points(self.names)
            own = self.hashes(m)[n - 1, np.arange(len(n)), 0]
        order = np.argsort(own)
        self.hash, self.id = own[order], order
        assert (self.hash[1:] != self.hash[:-1]).all(), "pieces share a hash"

    def hashes(self, m: np.ndarray) -> np.ndarray:
        """``[length - 1, word, start]``: hash of the characters from start on."""
        out = np.zeros((self.longest, *m.shape), np.uint64)
        with np.errstate(over="ignore"):
            c = (m.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
            c ^= c >> np.uint64(29)
            h = np.zeros_like(c)
            for k in range(min(self.longest, m.shape[1])):
                h[:, : m.shape[1] - k] = h[:, : m.shape[1] - k] * BASE + c[:, k:]
                out[k] = h
        return out

    def lattice(self, m: np.ndarray, left: np.ndarray, starts: int) -> np.ndarray:
        """``[length - 1, word, start]``: id of the piece there, or -1. ``left``: characters of each word from start 0 on."""
        out = np.full((self.longest, len(m), starts), -1, np.int32)
        if not len(self.hash):
            return out
        h = self.hashes(m)
        for k in range(min(self.longest, m.shape[1])):
            row, start = np.nonzero(np.arange(starts)[None, :] + k < left[:, None])
            own = h[k, row, start]
            at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
            out[k, row, start] = np.where(self.hash[at] == own, self.id[at], -1)
        return out


def forward(pieces: Pieces, m: np.ndarray, n: np.ndarray, p: np.ndarray, block: int = 48) -> np.ndarray:
    """``[word, language]``: log of the probability of all ways to cut each word; ``p[piece, language]``, the last row for unknown.

    Of the positions only those that a piece from the present one can reach are held.
    """
    words, langs, ring = len(m), p.shape[1], pieces.longest + 1
    out, shift = np.full((words, langs), -np.inf), np.zeros((words, langs))
    a = np.zeros((ring, words, langs))  # position i lies at i % ring
    a[0] = 1.0
    top = int(n.max()) if words else 0
    for begin in range(0, top, block):
        width = min(block, top - begin)
        lattice = pieces.lattice(m[:, begin : begin + width + pieces.longest], n - begin, width)
        for i in range(begin, begin + width):
            now = a[i % ring]
            for k in range(min(pieces.longest, top - i)):
                ids = lattice[k, :, i - begin]
                some = np.flatnonzero((ids >= 0) | (k == 0))
                if len(some):
                    a[(i + k + 1) % ring, some] += now[some] * p[ids[some]]  # -1 is the last row
            now[:] = 0.0
            if i % 8 == 7:
                big = a.max(axis=0)
                big[big <= 0] = 1.0
                a /= big
                shift += np.log(big)
            done = np.flatnonzero(n == i + 1)
            if len(done):
                with np.errstate(divide="ignore"):
                    out[done] = np.log(a[(i + 1) % ring, done]) + shift[done]
    return out


class Memory:
    """What a worker has worked out of words: common ones come again in every batch. When it is full it begins anew."""

    def __init__(self, words: int = 300_000, floats: int = 4_000_000):
        self.words, self.floats = words, floats
        self.forget()
        common.remembered.append(self.forget)

    def forget(self) -> None:
        self.name, self.place, self.rows = None, {}, np.zeros((0, 0))

    def of(self, model: Model, words: list[str]) -> np.ndarray:
        """Log-probabilities of distinct words, as ``model.logs`` gives them."""
        langs = max(1, len(model.langs))
        room = min(self.words, self.floats // langs)
        if len(words) > room:
            return model.logs(words)
        new = [w for w in words if w not in self.place] if self.name == model.name else words
        if self.name != model.name or len(self.place) + len(new) > room:
            self.name, self.place, self.rows, new = model.name, {}, np.zeros((1024, langs)), words
        begin, end = len(self.place), len(self.place) + len(new)
        if new:
            if end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(end, min(room, 2 * len(self.rows))) - len(self.rows), langs))])
            self.rows[begin:end] = model.logs(new)
            self.place.update(zip(new, range(begin, end)))
        return self.rows[np.fromiter((self.place[w] for w in words), np.int64, len(words))]


MEMORY = Memory()


class Model:
    """Languages and piece probabilities."""

    def __init__(self, pieces: Pieces, langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p, self.name = pieces, langs, p, uuid.uuid4().hex

    def logs(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        n = np.array([len(w) for w in words])
        for part in alike(n):
            out[part] = forward(self.pieces, *code_points([words[i] for i in part.tolist()]), self.p)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        count = np.array([len(w) for w in words])
        flat = pa.array([x for w in words for x in w], pa.string()).dictionary_encode()
        if not len(flat) or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs = MEMORY.of(self, flat.dictionary.to_pylist())[np.asarray(flat.indices)]
        doc = np.repeat(np.arange(len(texts)), count)
        total = np.stack([np.bincount(doc, logs[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return ["und" if not c else self.langs[b] for b, c in zip(best.tolist(), count.tolist())], np.where(count > 0, score, 0.0)


def uses(pieces: Pieces, m: np.ndarray, n: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words up to ``LEARNED`` characters, by forward and backward sums."""
    lattice, words, top = pieces.lattice(m, n, m.shape[1]), np.arange(len(n)), m.shape[1]
    a, b = np.zeros((top + 1, len(n))), np.zeros((top + 1, len(n)))
    a[0], b[n, words] = 1.0, 1.0
    reach = lambda i: [(k, lattice[k, :, i]) for k in range(min(pieces.longest, top - i))]
    for i in range(top):
        for k, ids in reach(i):
            some = np.flatnonzero((ids >= 0) | ((k == 0) & (i < n)))
            a[i + k + 1, some] += a[i, some] * p[ids[some]]
    for i in reversed(range(top)):
        for k, ids in reach(i):
            some = np.flatnonzero((ids >= 0) | ((k == 0) & (i < n)))
            b[i, some] += p[ids[some]] * b[i + k + 1, some]
    scale = weight / np.maximum(a[n, words], 1e-300)
    out = np.zeros(len(pieces.names))
    for i in range(top):
        for k, ids in reach(i):
            some = np.flatnonzero(ids >= 0)
            out += np.bincount(ids[some], a[i, some] * p[ids[some]] * b[i + k + 1, some] * scale[some], len(out))
    return out


def estimate(pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = 4) -> Model:
    """Expectation maximisation: expected uses of each piece over all segmentations of a language's words."""
    langs = sorted(counts)
    p = np.zeros((len(pieces.names) + 1, len(langs)))
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        n = np.array([len(w) for w in words], int)
        own = np.full(len(pieces.names) + 1, 1.0 / max(1, len(pieces.names)))
        own[-1] = UNKNOWN
        for _ in range(rounds if words else 0):
            total = sum((uses(pieces, *code_points([words[i] for i in part.tolist()]), own, weight[part]) for part in alike(n)), np.zeros(len(pieces.names)))
            own[:-1] = (total + 0.01) / (total.sum() + 0.01 * len(total))
        p[:, k] = own
    return Model(pieces, langs, p)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, model_path: str, sample: int = 4_000, words: int = 20_000) -> Model:
    """The model of the documents that are not held out; at most ``words`` words a language travel to the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return estimate(Pieces(model_path), {})
    each = max(1, sample // len(sizes))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(common.least_hashes(min(1.0, each / n))))])
    chosen = rows.filter(F.xxhash64("doc_id") <= share[F.col("lang")]).select("lang", "text")

    def spelled(batches):
        for b in common.pieces(batches, "text"):
            lang = b.column("lang").to_pylist()
            pairs = [(x, w) for x, t in zip(lang, common.texts_of(b)) for w in words_of(t) if len(w) <= LEARNED]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["lang", "word"])

    counted = chosen.mapInArrow(spelled, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    common_ones = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= words)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, word, n in zip(*(common_ones.select("lang", "word", "n").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])[c].to_pylist() for c in ("lang", "word", "n"))):
        counts[lang][word] = n
    return estimate(Pieces(model_path), counts)


def identified(docs: DataFrame, model_path: str, sample: int = 4_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, model_path, sample))  # the vocabulary times the languages

    def run(batches):
        for b in common.pieces(batches, "text", 4 << 20, remember=True):
            lang, score = shared.value.predict(common.texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
