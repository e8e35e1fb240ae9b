"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask selects positions of a run of words and ignores those between. Seeds (hashes of the selected words) of the
benchmark are joined with seeds at every position of every document, and each hit is verified on its alignment: a
window of ``window`` aligned words in which ``similarity`` of them or more agree. With masks whose steps are 3 and 4
no such window is missed: of two differing words in 13, three shifts of the first mask lose two at most; 0.8 of 13
words allows two. An item of fewer words is one window, of which the same share must agree; its masks take every second or
third word, one more than may differ, so one of them is always whole. Items of fewer than ``least`` words (five, as of
shingles) are no evidence.

Of a benchmark item the words around each position travel, not the item: the seeds of equal surroundings are one, and so
are hits of equal surroundings in one document, so runs of one word cost their length, not its square. The benchmark's
seeds are broadcast while they take at most ``most_broadcast`` bytes (measured first); beyond that both sides are
shuffled by seed and the hits joined back to the texts. The result is the same.

Words are lower-cased and parted by white space; ``.,;:!?"()`` are dropped. Nulls, ties, repeats: a null text has no
words; hits of rows with the same ``doc_id`` are reported together, a null ``doc_id`` as null; of windows that agree
equally the first counts; empty tables give no rows; other columns are ignored; a very long text is compared whole. A row
is returned for each pair of document and item found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Selected positions of each mask; the ignored ones let substitutions through.
MASKS = ((0, 3, 6, 9), (0, 4, 8, 12))


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r'[.,;:!?"()]', "")
    return F.array_remove(F.split(plain, "[ \\x09-\\x0D]+"), "")


def needed(width: int, similarity: float) -> int:
    """Words of ``width`` that must agree."""
    return math.ceil(round(similarity * width, 6))


def short_masks(width: int, similarity: float) -> list[tuple[int, ...]]:
    """Masks of which one at least is whole wherever enough words of an item of ``width`` agree."""
    step = width - needed(width, similarity) + 1
    return [tuple(range(k, width, step)) for k in range(step)]


def seeds(array: str, place: str, masks, shorts: list[int], similarity: float) -> Column:
    """The seeds that begin at a place: one for each mask, then those of items of each short length; null where words run out."""
    p, size = F.col(place), F.size(array)
    at = lambda o: F.get(F.col(array), p + o)
    out = [F.when(p + m[-1] < size, F.xxhash64(F.lit(k), *map(at, m))) for k, m in enumerate(masks)]
    out += [F.when(p + n <= size, F.xxhash64(F.lit(-n), F.lit(k), *map(at, m))) for n in shorts for k, m in enumerate(short_masks(n, similarity))]
    return F.array(*out)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, least: int = 5, masks=MASKS, most_broadcast: int = 64 << 20) -> DataFrame:
    """``doc_id, item_id, matched, first_word``: most agreeing words in a window, and where the first such window begins."""
    slack = window - 1 - min(m[-1] for m in masks)  # a window that holds a seed begins at most so many words before it
    span = window + slack
    begun = lambda c: F.greatest(F.col(c) - slack, F.lit(0))

    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("item")).filter(F.size("item") >= least)
    shorts = sorted(r[0] for r in items.filter(F.size("item") < window).select(F.size("item")).distinct().collect())  # below ``window`` numbers
    kinds = [*[0] * len(masks), *(n for n in shorts for _ in short_masks(n, similarity))]  # 0: items of a window or more
    placed = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.size("item") < window, 0).otherwise(F.size("item") - 1))))
    placed = placed.select("item_id", "item", "j", F.posexplode(seeds("item", "j", masks, shorts, similarity)).alias("kind", "seed"))
    fits = F.get(F.array(*map(F.lit, kinds)), F.col("kind")) == F.when(F.size("item") < window, F.size("item")).otherwise(0)
    around = F.slice("item", begun("j") + 1, F.lit(span))
    own = placed.filter(F.col("seed").isNotNull() & fits).select("seed", "item_id", F.least("j", F.lit(slack)).alias("left"), F.least(F.size("item") - F.col("j"), F.lit(window)).alias("right"), F.least(F.size("item"), F.lit(window)).alias("width"), around.alias("b")).distinct()
    size = own.agg(F.sum(F.aggregate("b", F.lit(96).cast("long"), lambda n, x: n + F.octet_length(x) + 16))).first()[0] or 0
    few = size <= most_broadcast

    # what a hit's verification needs of the document: the words around it and how far its ends are
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    sides = lambda: (F.least("i", F.lit(slack)).alias("before"), F.least(F.size("words") - F.col("i"), F.lit(window)).alias("after"), F.slice("words", begun("i") + 1, F.lit(span)).alias("a"))
    if few:
        starts = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words"))))
        marked = starts.select("doc_id", "words", "i", F.explode(seeds("words", "i", masks, shorts, similarity)).alias("seed"))
        hits = marked.join(F.broadcast(own), "seed").select("doc_id", "item_id", "i", "left", "right", "width", "b", *sides())
    else:
        keyed = texts.withColumn("row", F.xxhash64("doc_id", "words"))
        starts = keyed.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words"))))
        marked = starts.select("doc_id", "row", "i", F.explode(seeds("words", "i", masks, shorts, similarity)).alias("seed")).filter("seed is not null")
        found = marked.join(own, "seed").drop("seed").distinct()
        hits = found.join(keyed.withColumnRenamed("doc_id", "own_id"), (found["row"] == keyed["row"]) & found["doc_id"].eqNullSafe(F.col("own_id")))
        hits = hits.select("doc_id", "item_id", "i", "left", "right", "width", "b", *sides())

    # equal surroundings in a document give equal windows: the first stands for all; reduced before the exchange too
    near = hits.groupBy("doc_id", "item_id", "left", "right", "width", "b", "before", "after", "a").agg(F.min("i").alias("i"))
    equal = [F.coalesce((F.get("a", F.col("before") + o) == F.get("b", F.col("left") + o)).cast("int"), F.lit(0)).alias(f"e{n}") for n, o in enumerate(range(-slack, window))]
    sized = near.select("doc_id", "item_id", "i", "left", "right", "width", "before", "after", *equal)
    sums = []
    for begin in range(-slack, 1):  # a window from i + begin
        inside = (F.col("before") + begin >= 0) & (F.col("left") + begin >= 0) & (F.col("width") + begin <= F.col("after")) & (F.col("width") + begin <= F.col("right"))
        e = [F.col(f"e{begin + slack + o}") for o in range(window)]
        sums.append(F.when(inside, sum(e[1:], e[0])).otherwise(F.lit(0)).alias(f"s{begin + slack}"))
    scored = sized.select("doc_id", "item_id", "i", "width", *sums)
    names = [F.col(f"s{k}") for k in range(slack + 1)]
    need = F.get(F.array(*(F.lit(needed(n, similarity)) for n in range(window + 1))), F.col("width"))
    best = F.greatest(*names) if slack else names[0]
    first = F.coalesce(*(F.when(c >= need, F.col("i") - slack + k) for k, c in enumerate(names)))
    found = scored.select("doc_id", "item_id", F.when(best >= need, best).alias("sum"), first.alias("at"))
    kept = found.groupBy("doc_id", "item_id").agg(F.max("sum").cast("long").alias("matched"), F.min("at").cast("long").alias("first_word"))
    return kept.filter("matched is not null")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; rows without ``doc_id`` stay unless one such row holds one."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    name = common.unused(docs, "found_id")
    found = found.withColumnRenamed("doc_id", name)
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


#: The same by brute force: every aligned pair of equal words, windows by counting along each alignment.
SQL = """
with d as (
  select doc_id, [w for w in regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?"()', ''), '[ \\x09-\\x0D]+') if w <> ''] as words from documents
), b as (
  select item_id, [w for w in regexp_split_to_array(translate(lower(coalesce(text, '')), '.,;:!?"()', ''), '[ \\x09-\\x0D]+') if w <> ''] as item from benchmark
), dw as (select doc_id, len(words) as nd, unnest(words) as w, unnest(range(len(words))) as i from d),
bw as (select item_id, len(item) as nb, cast(ceil(round(0.8 * least(13, len(item)), 6)) as integer) as need, unnest(item) as w, unnest(range(len(item))) as j from b where len(item) >= 5),
dense as (
  select doc_id, item_id, nd, nb, need, i - j as shift from dw join bw using (w) group by all having count(*) >= need
), pairs as (
  select dense.doc_id, dense.item_id, dense.nd, dense.nb, dense.need, shift, i
  from dense join dw on dw.doc_id = dense.doc_id join bw on bw.item_id = dense.item_id and bw.j = dw.i - dense.shift and bw.w = dw.w
), spots as (
  select distinct doc_id, item_id, nd, nb, need, shift, least(13, nb) as width, unnest(range(i - least(13, nb) + 1, i + 1)) as s from pairs
), counted as (
  select spots.doc_id, spots.item_id, spots.s, spots.need, count(*) as n
  from spots join pairs on pairs.doc_id = spots.doc_id and pairs.item_id = spots.item_id and pairs.shift = spots.shift and pairs.i between spots.s and spots.s + width - 1
  where spots.s >= greatest(0, spots.shift) and spots.s + width <= least(spots.nd, spots.shift + spots.nb)
  group by spots.doc_id, spots.item_id, spots.s, spots.width, spots.need, spots.shift
)
select doc_id, item_id, cast(max(n) as bigint) as matched, cast(min(s) as bigint) as first_word
from counted where n >= need group by doc_id, item_id
"""
