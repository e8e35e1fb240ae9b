"""What texts tell about a company: keyword and pattern inference, with confidence.

All words are looked for in one pass over a text, by an automaton in an Arrow-batched UDF; what they mean, the patterns and the
confidence are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add, or_

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import fixed, variants


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: All words that count, each with a bit of its own; some patterns need one of theirs.
WORDS = sorted({w.lower() for group in (*fixed.INDUSTRIES.values(), *fixed.SIZE_WORDS.values(), *(ws for field in fixed.PATTERN_WORDS.values() for ws in field)) for w in group})
#: Bits that a long has room for.
BITS = 62


#: Patterns whose matches begin with one of their words, so that nothing before the first of these needs to be searched.
AHEAD = [("digits", 1), ("contact_name", 0), ("contact_name", 1), ("contact_name", 2), ("contact_title", 0), ("founded_year", 0), ("founded_year", 1), ("founded_year", 3)]


@lru_cache(1)
def automaton() -> tuple[ahocorasick.Automaton, dict[int, tuple[int, list[int]]]]:
    """Finds the bits of words; and for each bit the word's length and the places in AHEAD that it matters for."""
    out = ahocorasick.Automaton()
    for i, w in enumerate(WORDS):
        out.add_word(w, 1 << i)
    out.make_automaton()
    return out, {1 << i: (len(w), [k for k, (field, n) in enumerate(AHEAD) if w in {x.lower() for x in fixed.PATTERN_WORDS[field][n]}]) for i, w in enumerate(WORDS)}


HITS = T.StructType([*(T.StructField(f"b{k}", T.LongType()) for k in range(-(-len(WORDS) // BITS))), *(T.StructField(f"p{k}", T.IntegerType()) for k in range(len(AHEAD)))])


@F.arrow_udf(HITS)
def words_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Which WORDS stand in each lower-cased text, as bits, none in a null; and for patterns in AHEAD how many letters stand before the first of their words.

    Of a batch one text at a time is a Python object.
    """
    for texts in batches:
        columns = np.array([hits_in(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(HITS)).T
        yield pa.StructArray.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, HITS)], [f.name for f in HITS])
        pa.default_memory_pool().release_unused()


def hits_in(text: str | None) -> list[int]:
    every, told = automaton()
    longs, bits, begins = -(-len(WORDS) // BITS), 0, [0] * len(AHEAD)
    for end, bit in every.iter(text or ""):
        if bit & ~bits:
            bits |= bit
            size, places = told[bit]
            for k in places:
                begins[k] = min(begins[k] or end + 2, end + 2 - size)  # from 1
    return [*(bits >> (BITS * k) & ((1 << BITS) - 1) for k in range(longs)), *(max(0, b - 1) for b in begins)]


def masked(hits: Column, words: list[str]) -> list[Column]:
    """The bits of ``words`` among those found, a column for each long that has some."""
    mask = sum(1 << WORDS.index(w) for w in {w.lower() for w in words})
    parts = [(k, mask >> (BITS * k) & ((1 << BITS) - 1)) for k in range(-(-len(WORDS) // BITS))]
    return [hits[f"b{k}"].bitwiseAND(F.lit(m).cast("long")) for k, m in parts if m]


def some_of(hits: Column, words: list[str]) -> Column:
    return reduce(or_, (m != 0 for m in masked(hits, words)))


def many_of(hits: Column, words: list[str]) -> Column:
    return reduce(add, (F.bit_count(m) for m in masked(hits, words)))


def industry(hits: Column) -> Column:
    """The industry with most of its keywords in the text; the first in order of those that tie; null for none."""
    counts = [(name, many_of(hits, words)) for name, words in fixed.INDUSTRIES.items()]
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts))))
    return F.when(best["n"] > 0, best["name"])


def employees(hits: Column, digits: Column) -> Column:
    """Size band by words of the text, else by the number that counts people."""
    out = None
    for band, words in fixed.SIZE_WORDS.items():
        some = some_of(hits, words)
        out = F.when(some, band) if out is None else out.when(some, band)
    # digits beyond any integer type are more than the highest bound
    n = F.coalesce(F.when(F.length(F.ltrim(digits, F.lit("0"))) < 10, digits).cast("long"), F.lit(10**12))
    by_count = None
    for most, band in fixed.SIZE_BOUNDS:
        by_count = F.when(n <= most, band) if by_count is None else by_count.when(n <= most, band)
    return out.otherwise(F.when(digits.isNotNull(), by_count.otherwise(fixed.SIZE_ABOVE)))


def revenue_band(band: Column) -> Column:
    out = None
    for name, value in fixed.REVENUE.items():
        out = F.when(band == name, value) if out is None else out.when(band == name, value)
    return out


def year(found: Column) -> Column:
    """A year from 1900 to 2030, else null."""
    y = F.when(found.startswith("'"), F.concat(F.lit("20"), F.substring(found, 2, 2))).otherwise(found).cast("int")
    return F.when(y.between(1900, 2030), y)


#: Patterns by the field they serve, in the order in which they are tried.
PATTERNS = {"digits": fixed.SIZE_PATTERNS, "contact_name": fixed.CONTACT_PATTERNS, "contact_title": fixed.TITLE_PATTERNS, "founded_year": fixed.YEAR_PATTERNS}
FIELDS = tuple(fixed.HEURISTIC_WEIGHTS)


def inferred(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the six inferred columns and ``confidence`` (null if nothing was found).

    The text is lower-cased and searched for words once, and each pattern is matched once, and only where one of its words
    stands at all. Each step is a projection of its own that the next ones refer to several times, so they are not merged
    into one that repeats the work.
    """
    low, hits = "_low", F.col("_hits")
    out = rows.withColumn(low, F.lower(text)).withColumn("_hits", words_in(F.col(low)))

    def has(field: str, i: int) -> Column:
        words = fixed.PATTERN_WORDS[field][i]
        some = some_of(hits, words)
        return some & reduce(or_, (F.col(text).contains(w) for w in words)) if field == "contact_name" else some  # names count as they are written

    def within(field: str, i: int) -> Column:
        """What the pattern is to be found in; letters before its first word are left out where lower-casing kept their number."""
        source = F.col(low if field == "digits" else text)
        if (field, i) not in AHEAD:
            return source
        rest = F.substr(source, hits[f"p{AHEAD.index((field, i))}"] + 1)
        return F.when(F.length(low) == F.length(text), rest).otherwise(source)

    out = out.withColumns({f"_{field}{i}": F.when(has(field, i), F.regexp_extract(within(field, i), p, 1)) for field, patterns in PATTERNS.items() for i, p in enumerate(patterns)})
    found = {field: [F.nullif(F.col(f"_{field}{i}"), F.lit("")) for i in range(len(patterns))] for field, patterns in PATTERNS.items()}
    out = out.withColumns({
        "industry": industry(hits), "employees": employees(hits, F.coalesce(*found["digits"])), "contact_name": F.coalesce(*found["contact_name"]),
        "contact_title": F.initcap(F.coalesce(*found["contact_title"])), "founded_year": F.coalesce(*map(year, found["founded_year"])),
    })
    out = out.withColumn("revenue_band", revenue_band(F.col("employees")))
    total, some = F.lit(0.0), F.lit(False)
    for name, weight in fixed.HEURISTIC_WEIGHTS.items():
        total = total + F.when(F.col(name).isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
        some = some | F.col(name).isNotNull()
    out = out.withColumn("confidence", F.when(some, F.least(total, F.lit(fixed.HEURISTIC_CAP))))
    return out.select(*rows.columns, *("industry", "employees", "contact_name", "contact_title", "founded_year", "revenue_band"), "confidence")


def language_model_confidence(fields: list[Column]) -> Column:
    """For what a language model returned: half, and a tenth for each field."""
    n = sum((f.isNotNull().cast("int") for f in fields[1:]), fields[0].isNotNull().cast("int"))
    return F.least(F.lit(0.5) + F.lit(0.1) * n, F.lit(0.8))


def waterfall(rows: DataFrame, text: str = "text", external=None, model=None) -> DataFrame:
    """``rows`` with the six fields, ``confidence`` and ``method`` of the first of three ways that passes its gate, else nulls.

    Inference must be surer than 0.7; ``external``, a function from the text to a struct of the six fields and a
    ``confidence``, surer than 0.6; ``model``, one from the first 2000 characters of the text to a struct of the six fields,
    counts where it gives any; a struct with ``named`` says itself how many values it has. Both are off by default; they get a null text where an earlier way has passed.
    """
    names = [*FIELDS, "confidence"]
    found = inferred(rows, text).withColumn("_one", F.struct(*names)).drop(*names)
    method, ways = F.when(F.col("_one.confidence") > fixed.GATE_HEURISTIC, F.lit("heuristic")), ["_one"]
    found = found.withColumn("method", method)
    waiting = lambda: F.when(F.col("method").isNull(), F.col(text))
    if external is not None:
        found = found.withColumn("_two", external(waiting()))
        found = found.withColumn("method", F.coalesce("method", F.when(F.col("_two.confidence") > fixed.GATE_EXTERNAL, F.lit("external_api"))))
        ways.append("_two")
    if model is not None:
        found = found.withColumn("_three", model(F.substring(waiting(), 1, 2000)))
        given = [F.col(f"_three.{c}") for c in FIELDS]
        names_all = "named" in found.schema["_three"].dataType.names
        found = found.withColumn("_sure", F.least(F.lit(0.5) + F.lit(0.1) * F.col("_three.named"), F.lit(0.8)) if names_all else language_model_confidence(given))
        found = found.withColumn("method", F.coalesce("method", F.when(F.col("_three.named") > 0 if names_all else F.coalesce(*(c.cast("string") for c in given)).isNotNull(), F.lit("llm"))))
        ways.append("_three")
    kinds = {"_one": "heuristic", "_two": "external_api", "_three": "llm"}

    def of(name: str) -> Column:
        out = None
        for w in ways:
            value = F.col("_sure") if (w, name) == ("_three", "confidence") else F.col(f"{w}.{name}")
            here = F.col("method") == kinds[w]
            out = F.when(here, value) if out is None else out.when(here, value)
        return out

    return found.select(*rows.columns, *(of(n).alias(n) for n in names), "method")

#: How many prompts go to a model at once.
TOGETHER = 16


def asked(rows: DataFrame, prompt: str, ask: Callable[[list[str]], list[str | None]], together: int = TOGETHER) -> DataFrame:
    """``prompt, answer`` for each distinct prompt of ``rows`` that is not null, which is asked once.

    ``ask`` takes up to ``together`` prompts and gives as many answers, as texts; what it raises leaves its prompts without an answer.
    Write the result before it is used several times: a plan that reads it twice asks twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = b["prompt"].tolist()
            for i in range(0, len(prompts), together):
                part = prompts[i : i + together]
                try:
                    answers = list(ask(part))
                except Exception:  # a model that fails leaves leads to what else is known of them
                    answers = []
                yield pd.DataFrame({"prompt": part, "answer": pd.Series((answers + [None] * len(part))[: len(part)], dtype=object)})

    return rows.select(F.col(prompt).alias("prompt")).filter("prompt is not null").distinct().mapInPandas(run, "prompt string, answer string")


def told(answer: Column) -> Column:
    """The fields that a model's answer names: what stands between its first and its last brace, read as JSON.

    A struct of the six fields and ``named``, how many keys of the answer have a value, whatever their names; null where there are no
    braces, what is between them is malformed, or all is null. A value of another type than its field's is no value.
    """
    v = variants.parsed(F.regexp_extract(answer, r"(?s)\{.*\}", 0))
    typed = lambda c: F.try_variant_get(v, f"$.{c}", "int") if c == "founded_year" else F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) == "STRING", F.try_variant_get(v, f"$.{c}", "string"))
    named = F.size(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: ~F.is_variant_null(x)))
    out = F.struct(*(typed(c).alias(c) for c in FIELDS), named.alias("named"))
    return F.when(named > 0, out)


def answered(rows: DataFrame, prompt: str, answers: DataFrame, into: str) -> DataFrame:
    """``rows`` with what the ``answers(prompt, answer)`` to their prompts say, as a struct ``into`` (see ``told``).

    Rows meet answers by a digest of the prompt, so long prompts are not shuffled as keys beside the rows.
    """
    known = answers.select(F.sha2("prompt", 256).alias("_asked"), "answer").dropDuplicates(["_asked"])
    joined = rows.withColumn("_asked", F.sha2(F.col(prompt), 256)).join(known, "_asked", "left")
    return joined.withColumn(into, told(F.col("answer"))).drop("_asked", "answer")
