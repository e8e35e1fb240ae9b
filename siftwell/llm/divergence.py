"""Source divergence audit: how far the sources of a language are apart in the terms they use.

1. Texts are cut into terms in Arrow batches; each task adds up occurrences and documents of a term before anything is
   shuffled, in a table of bounded size. Rows are then one for each language, source and term, so no key is hot: a term
   that all documents have is as many rows as there are sources.
2. Joint count histograms. For each pair of sources the cells (count here, count there) of their common terms are tallied;
   cells with a zero on one side follow from each source's own histogram less what is common, and those with two zeros
   from the number of terms. The difference is evaluated once for each combination, times its multiplicity.
3. Terms that a source uses more than its language are ranked by the difference; only the first of each source leave a task.

All arithmetic is on integers and decimals.

Nulls, ties, repeats: a null text, language or source is ''; each row is a document of its own, repeats included; equal
values are ranked by the bytes of the item; a source without terms is a source; a language without kept terms has pairs
at 0; an empty table gives no rows; other columns are ignored. Very long texts are cut into terms a piece at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNIT, SMOOTH = 1_000_000_000, 5
#: ASCII letters in lower case and all bytes from 128 on make terms; what parts them becomes a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces_of(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes, cut at blanks."""
    start = 0
    while len(data) - start > most:
        stop = data.rfind(b" ", start, start + most)
        stop = data.find(b" ", start + most) if stop <= start else stop
        if stop < 0:
            break
        yield data[start:stop]
        start = stop
    yield data[start:]


def counts_of(lang: str, source: str, terms: list[bytes | None], n: list[int], docs: list[int]) -> pa.RecordBatch:
    many = len(terms)
    columns = {"lang": pa.array([lang] * many, pa.string()), "source": pa.array([source] * many, pa.string()), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def counted(docs: DataFrame, entries: int = 200_000) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences in a source and documents that have the term; for each source one row
    without term. Tasks give away what they have counted when they hold ``entries`` terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in tally.items():
                yield counts_of(lang, source, list(n), list(n.values()), [d[t] for t in n])
            tally.clear()

        held = 0
        for batch in common.pieces(batches, "text"):
            for group, text in zip(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()), batch["text"]):
                if group not in seen:
                    seen.add(group)
                    yield counts_of(*group, [None], [0], [0])
                n, d = tally.get(group) or tally.setdefault(group, (Counter(), Counter()))
                before, own = len(n), set()
                for piece in pieces_of(text.as_buffer().to_pybytes().translate(LETTERS)):
                    terms = piece.split()
                    n.update(terms)
                    own.update(terms)
                d.update(own)
                held += len(n) - before
                if held > entries:
                    yield from given()
                    held = 0
        yield from given()

    known = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(known("lang"), known("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share in billionths, rounded down, and one."""
    whole = lambda c, digits=19: c.cast(f"decimal({digits},0)")
    few = lambda x: whole(F.lit(x), 10)
    return F.call_function("div", few(UNIT) * whole(whole(n) + few(SMOOTH), 20), whole(whole(total) + few(SMOOTH) * whole(terms), 38)) + F.lit(1)


class Audit:
    """Terms kept by each language and what follows; ``least``: documents of a language that a kept term is in."""

    def __init__(self, docs: DataFrame, least: int = 30):
        counts = common.table(counted(docs), "term-counts")
        own = Window.partitionBy("lang", "term")
        cells = counts.filter("term is not null").withColumns({"in_docs": F.sum("docs").over(own), "in_lang": F.sum("n").over(own), "lead": F.col("source") == F.min("source").over(own)})
        #: lang, source, term, n, in_lang, lead: a row for each kept term that a source has
        self.cells = common.table(cells.filter(F.col("in_docs") >= least).drop("docs", "in_docs"), "kept-terms")
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"), F.sum(F.col("lead").cast("long")).alias("lead"))
        rows = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n", "terms", "lead"])
        langs = rows.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("lead").alias("v"))
        #: lang, source, n (occurrences of kept terms), terms (kept terms it has), lang_n, v (kept terms of the language)
        self.groups = common.table(rows.drop("lead").join(langs, "lang"), "sources")

    def histograms(self) -> DataFrame:
        """``lang, one, two, a, b, many``: for each pair of sources, how many kept terms have count ``a`` in one and ``b`` in the other; zeros included."""
        here = lambda c, n: self.cells.select("lang", "term", F.col("source").alias(c), F.col("n").alias(n))
        common_terms = here("one", "a").join(here("two", "b"), ["lang", "term"]).filter("one < two")
        joint = common_terms.groupBy("lang", "one", "two", "a", "b").agg(F.count("*").alias("many"))
        # a term in both is not one of those that only one has, but one of two sources' terms is counted twice there
        cell = lambda a, b, many: F.struct(a.alias("a"), b.alias("b"), many.alias("many"))
        a, b, many, zero = F.col("a"), F.col("b"), F.col("many"), F.lit(0).cast("long")
        joint = joint.select("lang", "one", "two", F.inline(F.array(cell(a, b, many), cell(a, zero, -many), cell(zero, b, -many), cell(zero, zero, many))))
        alone = self.cells.groupBy("lang", "source", "n").agg(F.count("*").alias("many"))
        pairs = self.pairs()
        left = pairs.select("lang", "one", "two").join(alone.withColumnRenamed("source", "one"), ["lang", "one"]).select("lang", "one", "two", F.col("n").alias("a"), zero.alias("b"), "many")
        right = pairs.select("lang", "one", "two").join(alone.withColumnRenamed("source", "two"), ["lang", "two"]).select("lang", "one", "two", zero.alias("a"), F.col("n").alias("b"), "many")
        neither = pairs.select("lang", "one", "two", zero.alias("a"), zero.alias("b"), (F.col("v") - F.col("one_terms") - F.col("two_terms")).alias("many"))
        every = joint.unionByName(left).unionByName(right).unionByName(neither)
        return every.groupBy("lang", "one", "two", "a", "b").agg(F.sum("many").alias("many")).filter("many > 0")

    def pairs(self) -> DataFrame:
        side = lambda c: self.groups.select("lang", F.col("source").alias(c), F.col("n").alias(f"{c}_n"), F.col("terms").alias(f"{c}_terms"), *(["v"] if c == "one" else []))
        return side("one").join(side("two"), "lang").filter("one < two")

    def distances(self) -> DataFrame:
        """``lang, source, item, value``: the sum of differences over all kept terms, for each source and each other source."""
        pairs = self.pairs()
        h = self.histograms().join(pairs, ["lang", "one", "two"])
        apart = F.abs(share(F.col("a"), F.col("one_n"), F.col("v")) - share(F.col("b"), F.col("two_n"), F.col("v")))
        sums = h.groupBy("lang", "one", "two").agg(F.sum(apart * F.col("many")).alias("value"))
        value = pairs.select("lang", "one", "two").join(sums, ["lang", "one", "two"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
        both = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
        return value.select("lang", "value", both)

    def terms(self) -> DataFrame:
        """``lang, source, item, value`` of the terms that a source has and uses more than its language."""
        rows = common.met(self.cells, self.groups.select("lang", "source", F.col("n").alias("own"), "lang_n", "v"), ["lang", "source"], "term")
        rows = rows.withColumns({"p": share(F.col("n"), F.col("own"), F.col("v")), "q": share(F.col("in_lang"), F.col("lang_n"), F.col("v"))})
        return rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(w).cast("int"))
    return (out if most is None else out.filter(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audited(docs: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has all other sources of the language, part ``term`` the first ``most`` terms."""
    audit = Audit(docs, least)
    return ranked(audit.distances(), "pair").unionByName(ranked(audit.terms(), "term", most))


#: All cells, zeros included, one by one.
SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as materialized (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term, count(*) as n from t group by 1, 2 having count(distinct r) >= 30),
v as (select lang, count(*) as v, sum(n) as total from kept group by 1),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, k.n as in_lang, coalesce(o.n, 0) as n from g join kept k using (lang) left join (select lang, source, term, count(*) as n from t group by all) o using (lang, source, term)),
s as (select *, sum(n) over (partition by lang, source) as own from c),
p as materialized (select s.*, 1 + (1000000000::hugeint * (n + 5)) // (own + 5 * v.v) as p, 1 + (1000000000::hugeint * (in_lang + 5)) // (v.total + 5 * v.v) as q from s join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x on x.lang = a.lang and x.source = a.source and x.item = b.source),
every as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 50
"""
