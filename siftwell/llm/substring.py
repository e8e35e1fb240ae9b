"""Substring dedup with repeated-phrase automata.

1. Confirm recurring passages. Every window of ``window`` words has one anchor phrase in it: the least, by hash, of its
   phrases of ``phrase`` words. Each shard of documents names its anchor phrases, each once, and those that are named or
   stand more than once anywhere are confirmed. Equal windows have equal anchors, so every repeated window holds one.
2. Compile and stream. The confirmed phrases that a shard has named are compiled into its Aho-Corasick automaton, and all
   documents of the shard are streamed through it, two letters for each word. It locates every occurrence of the phrases,
   at anchors or not; only windows that hold one are candidates.
3. Candidate windows are counted over all shards by 96-bit hashes, each once a shard, and words of those that occur more
   than once are removed.

Exact copies are settled by digest, the first stands for all. What recurs within a shard leaves it once, so a phrase or
window of very many rows gives each task one row a shard at most. A shard is bounded in bytes, so its automaton is too.

Nulls, ties, repeats: a null text has no words; rows that agree in ``doc_id`` (or have none) and text are one document (a
row each is returned), so they are no repeat of each other; an empty table gives no rows; other columns are ignored. A
very long text is taken whole: one shard holds it.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shards import Corpus, Shard, anchors, copied, polynomial, repeated
from .textbytes import BASE, Words, mixed, word_hashes

#: Odd bases of the two hashes of a window.
BASES = (BASE, 0xD1B54A32D192ED03)
#: Where the first and second letters of words, and what parts documents, stand in the automaton's alphabet.
FIRST, SECOND, PART = 0x10000, 0x10100, 0x10200
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def letters(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash: enough to locate phrases of several words; windows are told apart by 96 of theirs."""
    return (hashes >> np.uint64(48)).astype(np.uint16)


def spelled(own: np.ndarray) -> np.ndarray:
    """Two letters for each word, from alphabets of their own, so a phrase is found at words' beginnings only; few letters keep the automaton's steps short."""
    return np.stack([(own >> 8) + np.uint32(FIRST), (own & 255) + np.uint32(SECOND)], axis=-1).astype("<u4")


def named_phrases(w: Words, counts: np.ndarray, hashes: np.ndarray, window: int, phrase: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct anchor phrases of the windows of ``counts`` words of each document, and how often each stands there."""
    own = letters(hashes)
    h = mixed(polynomial(own.astype(np.uint64) + np.uint64(1), phrase, BASE))
    at = anchors(h, window - phrase + 1, w.first[:-1], counts - window + 1)[0]
    _, one, n = np.unique(h[at], return_index=True, return_counts=True)
    runs = np.lib.stride_tricks.sliding_window_view(own, phrase)[at[one]] if len(one) else np.zeros((0, phrase), np.uint16)
    return pa.array([r.tobytes() for r in runs], pa.binary()), n


def located(w: Words, hashes: np.ndarray, phrases: list[bytes], size: int) -> np.ndarray:
    """First words of all occurrences of the phrases in the documents, by one automaton."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    every = spelled(np.frombuffer(b"".join(phrases), np.uint16)).tobytes().decode("utf-32-le")
    for i in range(0, len(every), 2 * size):
        automaton.add_word(every[i : i + 2 * size])
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    place = np.arange(len(w.begin)) + np.repeat(np.arange(w.docs), w.counts())  # one place parts documents
    stream = np.full((len(place) + w.docs, 2), PART, "<u4")
    stream[place] = spelled(letters(hashes))
    ends = np.fromiter((end for end, _ in automaton.iter(stream.tobytes().decode("utf-32-le"))), np.int64)
    return np.searchsorted(place, ends // 2) - size + 1


def windows(w: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, of 64 and 32 bits, of each run of ``window`` words, whatever document it begins in; each is
    made of hashes of the words of its own, ``hashes`` and those of another seed."""
    return mixed(polynomial(hashes, window, BASES[0])), (mixed(polynomial(word_hashes(w, 1), window, BASES[1])) >> np.uint64(32)).astype(np.uint32)


def twice(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of hashes stand more than once."""
    out = repeated(one)
    at = np.flatnonzero(out)
    order = np.lexsort((two[at], one[at]))
    a, b = one[at][order], two[at][order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out[at[order]] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(at) else False
    return out


def marked(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of ``size`` places: those in a span."""
    return np.cumsum(np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1))[:-1] > 0


def known(h1: np.ndarray, h2: np.ndarray, own1: np.ndarray, own2: np.ndarray) -> np.ndarray:
    """Which of the pairs ``own1, own2`` are among the pairs ``h1, h2``."""
    out = np.zeros(len(own1), bool)
    if len(h1):
        order = np.argsort(h1, kind="stable")
        h1, h2 = h1[order], h2[order]
        at = np.searchsorted(h1, own1)
        for k in range(int(np.bincount(np.unique(h1, return_inverse=True)[1]).max())):  # 1 unless hashes collide
            i = np.minimum(at + k, len(h1) - 1)
            out |= (h1[i] == own1) & (h2[i] == own2)
    return out


class Substrings:
    """Words of windows that recur; see the module. ``window`` words, anchors of ``phrase`` words."""

    def __init__(self, docs: DataFrame, window: int = 35, phrase: int = 8, carry: bool = False):
        self.window, self.phrase = window, min(phrase, window)
        self.corpus = Corpus(docs, carry)
        self.copies = self.corpus.copies()

    def phrases(self) -> DataFrame:
        """``shard, phrase``: confirmed phrases for each shard that named them."""
        window, phrase = self.window, self.phrase

        def name(shard: Shard, other: pa.Table, number: int) -> pa.Table:
            w = Words(shard.text)
            names, n = named_phrases(w, np.where(copied(shard, other)[1], w.counts(), 0), word_hashes(w), window, phrase)
            return pa.table({"shard": pa.array(np.full(len(n), number, np.int32)), "phrase": names, "n": pa.array(np.minimum(n, 2).astype(np.int32))})

        named = self.corpus.with_docs(self.copies, name, "shard int, phrase binary, n int")
        return counted(named, ["phrase"]).select("shard", "phrase")

    def recurring(self) -> DataFrame:
        """``shard, h1, h2``: hashes of windows that a shard has once and others have too."""
        window, phrase = self.window, self.phrase

        def locate(shard: Shard, other: pa.Table, number: int) -> pa.Table:
            w = Words(shard.text)
            hashes = word_hashes(w)
            start = located(w, hashes, other["phrase"].drop_null().to_pylist(), phrase)
            doc = np.searchsorted(w.first, start, "right") - 1
            first = np.maximum(start - window + phrase, w.first[doc])
            last = np.minimum(start, w.first[doc + 1] - window)
            some = (first <= last) & copied(shard, other)[1][doc]
            at = np.flatnonzero(marked(first[some], last[some] + 1, len(w.begin)))
            one, two = (h[at] for h in windows(w, hashes, window)) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)])
            n = np.minimum(np.diff(np.concatenate([new, [len(one)]])), 2)
            return pa.table({"h1": pa.array(one[new].view(np.int64)), "h2": pa.array(two[new].view(np.int32)), "shard": pa.array(np.full(len(new), number, np.int32)), "n": pa.array(n.astype(np.int32))})

        found = self.corpus.with_docs(self.copies.unionByName(self.phrases(), allowMissingColumns=True), locate, "h1 long, h2 int, shard int, n int")
        return counted(found, ["h1", "h2"]).filter("n = 1").select("shard", "h1", "h2")

    def apply(self, use, schema) -> DataFrame:
        """``use(shard, words, removed)`` on each shard; ``removed`` flags words."""
        window = self.window

        def run(shard: Shard, other: pa.Table, _: int) -> pa.Table:
            w = Words(shard.text)
            has, stands = copied(shard, other)
            n = w.counts()
            start = common.ranges(w.first[:-1], np.where(stands, np.maximum(n - window + 1, 0), 0))
            if len(start):
                one, two = (h[start] for h in windows(w, word_hashes(w), window))
                elsewhere = other.filter(other["h1"].is_valid())
                again = twice(one, two) | known(np.asarray(elsewhere["h1"]).view(np.uint64), np.asarray(elsewhere["h2"]).view(np.uint32), one, two)
                start = start[again]
            whole = np.flatnonzero(has & (n >= window))
            return use(shard, w, marked(np.concatenate([start, w.first[whole]]), np.concatenate([start + window, w.first[whole + 1]]), len(w.begin)))

        return self.corpus.with_docs(self.copies.unionByName(self.recurring(), allowMissingColumns=True), run, schema)


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand for more than one occurrence; each shard has a key once, so no key has more rows than shards."""
    return rows.withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("all") > 1)


def kept_words(w: Words, removed: np.ndarray, row: int) -> bytes:
    """The words that stay, joined by one blank."""
    i, j = w.first[row], w.first[row + 1]
    if i == j:
        return b""
    part = w.data[w.begin[i] : w.end[j - 1] + 1]
    stay = np.repeat(~removed[i:j], w.end[i:j] - w.begin[i:j] + 1)
    return part[stay].tobytes()[:-1]


def removed_words(w: Words, removed: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(removed)])
    return total[w.first[1:]] - total[w.first[:-1]]


def removals(docs: DataFrame, window: int = 35, phrase: int = 8) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""

    def digest(shard: Shard, w: Words, removed: np.ndarray) -> pa.Table:
        sha = [hashlib.sha256(kept_words(w, removed, r)).hexdigest() for r in range(w.docs)]
        return shard.repeat(pa.table({"doc_id": shard.doc_id, "n_words": pa.array(w.counts()), "n_removed": pa.array(removed_words(w, removed)), "kept_sha256": pa.array(sha, pa.string())}))

    return Substrings(docs, window, phrase).apply(digest, RESULT)


def without_repeats(docs: DataFrame, window: int = 50, phrase: int = 8) -> DataFrame:
    """The columns of ``docs``; repeated passages are cut out of the texts, other texts stay as they are, byte by byte."""

    def cut(shard: Shard, w: Words, removed: np.ndarray) -> pa.Table:
        gone = removed_words(w, removed)
        text = [kept_words(w, removed, r).decode("utf-8", "replace") if gone[r] else None for r in range(w.docs)]
        out = shard.repeat(pa.table({"text": pa.array(text, pa.string())}))
        return out.append_column("as_is", shard.rows["text"]).append_column("blank", shard.rows["blank"]).append_column("own", shard.rows["own"])

    sub = Substrings(docs, window, phrase, carry=True)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("as_is", T.StringType()), *(sub.corpus.rows.schema[c] for c in ("blank", "own"))])
    out = sub.apply(cut, schema)
    text = F.coalesce("text", F.when(~F.col("blank"), F.col("as_is")))
    return out.select(*[text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])


#: The removals by brute force over all windows.
SQL = """
with rows as (select doc_id, coalesce(text, '') as text, count(*) as times from documents group by all),
w as (
  select row_number() over () as k, doc_id, times, [x for x in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if x <> ''] as words from rows
), placed as (select k, unnest(words) as word, unnest(range(len(words))) as i from w),
windows as (
  select k, i, string_agg(word, ' ') over r as run, count(*) over r as n from placed
  window r as (partition by k order by i rows between current row and 34 following)
), again as (select run from windows where n = 35 group by run having count(*) > 1),
gone as (select distinct k, unnest(range(i, i + 35)) as i from windows join again using (run) where n = 35),
cut as (
  select w.k, count(gone.i) as n_removed, sha256(coalesce(string_agg(word, ' ' order by placed.i) filter (where gone.i is null), '')) as kept_sha256
  from w left join placed on placed.k = w.k left join gone on gone.k = placed.k and gone.i = placed.i group by w.k
)
select doc_id, cast(len(words) as bigint) as n_words, n_removed, kept_sha256
from (select *, unnest(range(times)) as copy from w) w join cut using (k)
"""
