"""Counting, packing, search and classifiers: brute force, round trips, held-out accuracy, awkward rows."""

import json
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm import ann, common, decontamination, language, packing, quality, token_counts, tokens, toxicity

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_token_counts_and_cache(spark, docs, rows, empty):
    t = Tokenizer.from_file(WORD)
    cache = common.shared_dir(spark, "cache")
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows)
    for _ in range(2):  # the second time all is known
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD, cache).collect())
        assert got == want
    entries = token_counts.read_cache(spark, cache)
    assert entries.count() == entries.select("tokenizer", "content").distinct().count()
    assert token_counts.token_counts(empty, WORD, common.shared_dir(spark, "cache")).count() == 0


def test_few_misses_leave_texts_where_they_lie(spark, tmp_path):
    """With a full cache and one new text no exchange has a text in it; with many misses there is one; the counts are the same."""
    t = Tokenizer.from_file(WORD)
    texts = [f"text number {i} of some" for i in range(300)] + ["same"] * 40
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for most in (0, 1 << 20):
        cache = common.shared_dir(spark, "cache")
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, WORD, cache, most_broadcast=most).collect()} == want
        assert token_counts.read_cache(spark, cache).count() == 301
    rows = docs.selectExpr("doc_id as owner", "unhex(sha2(text, 256)) as content", "text")
    one = common.table(rows.limit(1).select("owner", "content"), "one")
    plan = lambda most: token_counts.texts_of_misses(rows, one, 1, most)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(1 << 20) and "BroadcastExchange" in plan(1 << 20) and "hashpartitioning" in plan(0)


def test_first_runs_do_the_same_whatever_the_size(spark, monkeypatch):
    """All is missing: texts are shuffled in a small table as in a large one; later few are missing and those are broadcast."""
    ways, meet = [], token_counts.texts_of_misses
    monkeypatch.setattr(token_counts, "texts_of_misses", lambda rows, misses, many, most: ways.append((many, most)) or meet(rows, misses, many, most))
    docs, cache = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text"), common.shared_dir(spark, "cache")
    for table in (docs, docs.unionAll(spark.sql("select 40L, 'another text'"))):
        assert token_counts.token_counts(table, WORD, cache, most_broadcast=1 << 20).count() == table.count()
    assert ways == [(40, 0), (1, 1 << 20)]


@pytest.mark.parametrize("text", ["aµb", "don't we'll THEY'RE 's", "x\n\n y  z\t\tq \n", "foo123 bar_baz <|endoftext|> q", "İstanbul. ΑΣ. é.x", "a\xa0b", "½ ²x abc½", "   lead", "trail   ", "\n", "", "中文,abc"])
def test_chunks_give_the_ids_of_the_whole(text):
    assert list(memoryview(tokens.encoder(BYTE).of([text])[0]).cast("H")) == tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids
    assert tokens.counter(WORD).of([text])[0] == len(tokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_encode_whole_texts(spark, docs, rows, tmp_path):
    """A file with another way to split: nothing is assumed of it, and white space counts."""
    whole = json.load(open(BYTE))
    whole["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    path = str(tmp_path / "other.json")
    json.dump(whole, open(path, "w"))
    t = Tokenizer.from_file(path)
    assert tokens.cuts(path) is None and tokens.cuts(BYTE) == "spaced" and tokens.cuts(WORD) == "words"
    some = docs.filter("length(text) < 500")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(some, path, common.shared_dir(spark, "cache")).collect())
    assert got == sorted((r[0] is None, r[0] or 0, len(t.encode(r[1], add_special_tokens=False).ids)) for r in rows if r[1] is not None and len(r[1]) < 500)


def test_packing_round_trip(docs, rows, empty):
    ids = packing.encoded(docs, BYTE, 1)
    got = packing.cut(ids, "<u2", 64, with_ids=True).collect()
    t = Tokenizer.from_file(BYTE)
    by = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append(r)
    for number, parts in by.items():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        assert sum(p.length for p in parts) == 64 or number == max(by)
    # pieces in order give all documents, one after another
    whole = np.concatenate([np.frombuffer(p.ids, "<u4") for s in sorted(by) for p in by[s]])
    want = sorted(tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    docs_of, at = [], 0
    for p in (p for s in sorted(by) for p in by[s]):
        if p.start == 0:
            docs_of.append(tuple(whole[at : at + p.doc_tokens].tolist()))
        at += p.length
    assert sorted(docs_of) == want
    assert packing.pack(empty, BYTE).count() == 0


def test_decontamination_finds_substituted_passages(spark, empty):
    item = [f"q{i}" for i in range(30)]
    changed = [w if i not in (4, 9, 21) else "other" for i, w in enumerate(item)]
    broken = [w if i % 4 else "other" for i, w in enumerate(item)]
    rows = [(1, "before " + " ".join(item) + " after"), (2, " ".join(changed).upper() + "."), (3, " ".join(broken)), (4, None), (5, ""), (6, "a short item with six words, here and more"), (1, "twice"), (None, " ".join(item)), (7, "clean " * 3000), (8, "short thing of two words")]
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, "Short item of six words", 2), (12, None, 3), (13, "one two", 4), (14, " ".join(item), 5)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words", "3 as seed", "4 as found_id", "5 as FOUND_ID_")
    want = {(1, 10), (1, 14), (2, 10), (2, 14), (6, 11), (None, 10), (None, 14)}
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(r.matched, r.first_word) for r in got if r.doc_id == 1} == {(13, 1)} and [(r.matched, r.first_word) for r in got if r.doc_id == 6] == [(4, 1)]
    other = decontamination.contaminated(docs, bench, most_broadcast=0)
    assert sorted(map(str, other.collect())) == sorted(map(str, got))
    clean = decontamination.clean(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5, 7, 8} and clean.columns == docs.columns
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def windows_found(doc, item, window=13, least=5):
    """Most agreeing words in an aligned window, and where the first such window begins."""
    best, first, w = 0, None, min(window, len(item))
    need = decontamination.needed(w, 0.8)
    for s in range(len(doc) - w + 1) if len(item) >= least else ():
        for t in range(len(item) - w + 1):
            n = sum(a == b for a, b in zip(doc[s : s + w], item[t : t + w]))
            if n >= need:
                best, first = max(best, n), s if first is None else first
    return (best, first) if best else None


def test_decontamination_equals_brute_force(spark):
    """Items of all lengths against documents with all numbers of changed words, over few words so that much repeats."""
    r = np.random.default_rng(5)
    items = {n: [f"w{x}" for x in r.integers(0, 40, n)] for n in range(1, 31)} | {50: ["same"] * 20, 51: ["a", "b"] * 9}
    texts = {100: ["same"] * 40, 101: ["a", "b"] * 30, 102: ["b", "a", "a"] * 9}
    for i in range(80):
        text = [f"w{x}" for x in r.integers(0, 40, r.integers(0, 40))]
        own = list(items[int(r.choice(list(items)))])
        for k in r.choice(len(own), r.integers(0, len(own) // 3 + 1), replace=False):
            own[k] = "changed"
        at = int(r.integers(0, len(text) + 1))
        texts[i] = text[:at] + own + text[at:]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    want = sorted((i, k, *f) for i, t in texts.items() for k, x in items.items() if (f := windows_found(t, x)))
    for most in (1 << 26, 0):
        assert sorted(tuple(x) for x in decontamination.contaminated(docs, bench, most_broadcast=most).collect()) == want


def test_decontamination_of_runs_is_linear(spark):
    """20,000 equal words meet an item of as many; a long item; all in seconds."""
    long = [f"u{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, " ".join(long[500:600])), (None, "word " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 20_000), (2, " ".join(long))], "item_id long, text string")
    began = time.time()
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=str) == [(1, 1, 13, 0), (2, 2, 13, 0), (None, 1, 13, 0)]
    assert time.time() - began < 60


def test_toxicity(spark, empty):
    r = np.random.default_rng(2)
    bad = ["vilea", "vileb", "vilec"]
    rows, labels = [], []
    for i in range(400):
        words = [f"w{r.integers(300)}" for _ in range(r.integers(5, 60))]
        n = int(r.integers(1, 9)) if i % 8 == 0 else 0
        words += [bad[r.integers(3)] for _ in range(n)]
        rows.append((i, " ".join(r.permutation(words)), n))
        labels.append((i, int(n > 0)))
    labels += [(None, 1), (3, None), (0, 1)]
    docs = spark.createDataFrame([*rows, (None, "vilea", 1), (900, None, 0), (901, "", 0), (901, "", 0)], "doc_id long, text string, severity int").selectExpr("*", "1 as p_toxic_", "2 as toxic")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(docs, lab).toPandas()
    assert len(got) == 404
    truth = {i: n for i, _, n in rows}
    seen = got[got.doc_id.isin(truth)]
    assert (seen.toxic == (seen.doc_id.map(truth) > 0)).mean() > 0.98
    assert seen[seen.doc_id.map(truth) >= 6].severity.mean() > seen[seen.doc_id.map(truth).between(1, 2)].severity.mean() + 0.3
    assert not got[got.doc_id.isin([900, 901])].toxic.any()
    assert toxicity.scored(docs, lab.filter("toxic = 0")).filter("toxic or severity > 0").count() == 0
    assert toxicity.scored(empty, lab).count() == 0 and toxicity.scored(docs, lab.limit(0)).count() == 404


def test_nearest_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 12))
    x[100:160] = x[0]  # copies tie by id
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(50, x[50].tolist(), 2), (1000, None, 1), (1050, [0.0] * 12, 1), (1100, [float("nan")] * 12, 1), (1150, [1.0, None] + [0.0] * 10, 1), (None, x[1].tolist(), 1), (1200, [], 1), (1250, [1.0] * 3, 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").selectExpr("*", "1 as block", "2 as cell", "3 as v", "4 as content", "5 as ids")
    got = ann.search(docs).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s))[:5]
        g = g.sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(g.score, u[g.vec_id] @ u[q])
        hit += len(set(want) & set(g.vec_id))
    assert set(got.query_id) == set(range(0, 600, 50)) and hit >= 0.9 * 60
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [100, 101, 102, 103, 104]
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_are_found_where_vectors_lie_close_and_queries_elsewhere(spark):
    """Dense clusters whose vectors differ in the fourth decimal, with queries in them; and with queries far from all that is not one."""
    r = np.random.default_rng(3)
    close = r.normal(size=(20, 16))[r.integers(0, 20, 6000)] + 0.001 * r.normal(size=(6000, 16))
    apart = close.copy()
    apart[::50] = r.normal(size=(120, 16))
    for x in (close, apart):
        got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
        u = ann.unit(x)
        near = u[::50] @ u.T
        near[np.arange(120), np.arange(0, 6000, 50)] = -1
        least = np.sort(near, axis=1)[:, -5]
        assert len(got) == 600 and sum(h.score >= least[h.query_id // 50] - 1e-12 for h in got) >= 0.9 * 600


@pytest.mark.parametrize("block, part", [(20_000, 200_000), (40, 5)])
def test_neighbours_in_copies_and_blocks(spark, block, part):
    """All lists visited and reranked: the exact answer, ties by id, with copies in several blocks and queries in parts."""
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(150, 17)), 4, axis=0)[r.permutation(600)]
    x[200:500] = x[7]  # half of all
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for q in ann.search(table, query_every=10, recall=1.0, rerank=600, block=block, asked_part=part).collect():
        got.setdefault(q.query_id, {})[q["rank"]] = (q.vec_id, q.score)
    u = ann.unit(x)
    for q in range(0, 600, 10):
        s = ann.cosine(np.repeat(x[q : q + 1], 600, axis=0), x)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == want.tolist(), q
        assert np.allclose([got[q][k + 1][1] for k in range(5)], u[want] @ u[q])


def test_equal_vectors_have_equal_scores_anywhere():
    r = np.random.default_rng(8)
    for dim in (1, 3, 7, 8, 17, 64, 200):
        q, v = r.normal(size=dim), r.normal(size=dim)
        for n in (1, 2, 9, 64):
            x = r.normal(size=(n, dim))
            x[n // 2] = v
            assert ann.cosine(np.repeat(q[None], n, axis=0), x)[n // 2] == ann.cosine(q[None], v[None])[0]


def test_language(spark, empty):
    r = np.random.default_rng(6)
    of = {"en": ["the", "house", "thing", "with", "water"], "de": ["der", "sich", "schule", "nicht", "wasser"]}
    rows = [(i, " ".join(r.choice(of[lang], 20)), lang, "s") for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "s"), (501, "123 !?", "en", "s"), (502, "", None, "s"), (None, "the water", "en", "s"), (503, "wasserschule" * 30, None, "s"), (503, "wasserschule" * 30, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in language.identified(docs, path).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(120))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert got[503].lang_pred == "de" and got[None].lang_pred == "en" and 0 <= got[7].score <= 1
    assert language.identified(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"), path).filter("lang_pred <> 'und'").count() == 0
    assert language.identified(empty, path).count() == 0


def test_language_has_no_caps(spark):
    """Letters only, pieces and words of any length, and words far beyond what doubles hold."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.Pieces(path)
    assert {"▁relationship", "▁international"} <= set(pieces.names) and pieces.longest >= 13
    assert language.words_of("½² ① 12_a x9y") == ["▁a", "▁x", "▁y"] and language.words_of("हिन्दी") == ["▁हिन्दी"]
    of = {"en": "international relationship", "de": "wasserschule rechtsanwalt"}
    rows = [(i, of[("en", "de")[i % 2]], ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, "½²", None), (101, "①", None), (102, "international" * 5000, None), (103, "rechtsanwalt" * 5000 + " ½", None), (104, "relationship", None)]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert [got[i].lang_pred for i in (102, 103, 104)] == ["en", "de", "en"] and all(0 <= r.score <= 1 for r in got.values())
    tie = {r.doc_id: r.lang_pred for r in language.identified(spark.createDataFrame([(i, "same words here", ("b", "a")[i % 2]) for i in range(60)], "doc_id long, text string, lang string"), path).collect()}
    assert set(tie.values()) <= {"a", "b"}
    model = language.Model(pieces, ["a", "b", "c"], np.full((len(pieces.names) + 1, 3), 1e-3))
    assert model.predict(["same words", "x", ""])[0] == ["a", "a", "und"]  # the first of those that tie


def test_language_learns_from_very_many_documents():
    """A share of 10^10 documents is about the number wanted; a whole share is all."""
    for n in (10**5, 10**8, 10**10, 10**13):
        assert abs((common.least_hashes(1000 / n) + 2**63) / 2**64 * n - 1000) < 1
    assert common.least_hashes(1.0) == 2**63 - 1


def test_language_remembers_what_words_are_worth():
    pieces = language.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(1)
    one, two = (language.Model(pieces, ["a", "b"], r.random((len(pieces.names) + 1, 2))) for _ in range(2))
    memory = language.Memory(words=30)
    words = [f"▁w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    for model in (one, two, one):
        for part in (words[:20], words[10:25], words[5:35], words, words[:1], words[30:60], []):
            assert np.array_equal(memory.of(model, part), model.logs(part) if part else np.zeros((0, 2)))
    memory.forget()
    assert not memory.place and memory.of(one, words[:3]).shape == (3, 2)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    index = {p: i for i, p in enumerate(pieces.names)}
    p = np.random.default_rng(3).random((len(pieces.names) + 1, 2))

    def brute(word, lang):
        total = [1.0] + [0.0] * len(word)
        for i in range(len(word)):
            for k in range(1, len(word) - i + 1):
                if word[i : i + k] in index or k == 1:
                    total[i + k] += total[i] * p[index.get(word[i : i + k], -1), lang]
        return np.log(total[-1])

    words = [language.MARK + w for w in ("the", "strasse", "été", "中x", "international", "relationships" * 9)]
    m, n = language.code_points(words)
    for block in (5, 48, 1000):
        assert np.allclose(language.forward(pieces, m, n, p, block), [[brute(w, k) for k in (0, 1)] for w in words])
    some = np.concatenate(list(language.alike(n)))
    assert sorted(some.tolist()) == list(range(len(words)))


def test_expected_uses_equal_brute_force():
    pieces = language.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    index = {p: i for i, p in enumerate(pieces.names)}
    p = np.random.default_rng(3).random(len(pieces.names) + 1)

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in index or k == 1:
                for rest in cuts(word[k:]):
                    yield [index.get(word[:k], -1), *rest]

    words, weight = [language.MARK + w for w in ("water", "nation", "été")], np.array([1.0, 2.0, 5.0])
    want = np.zeros(len(pieces.names) + 1)
    for word, many in zip(words, weight):
        ways = [(c, np.prod(p[c])) for c in cuts(word)]
        total = sum(x for _, x in ways)
        for c, x in ways:
            for i in c:
                want[i] += many * x / total
    m, n = language.code_points(words)
    assert np.allclose(language.uses(pieces, m, n, p, weight), want[:-1])


def test_ordinal_gradient_and_likelihood():
    """The likelihood by its definition, the gradient by differences, for 1 and 3 thresholds."""
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 4))
    for top in (1, 3):
        grade, p = r.integers(0, top + 1, 40), np.concatenate([r.normal(size=4), [0.3], r.normal(size=top - 1) * 0.3])
        cuts = p[4] + np.concatenate([[0], np.cumsum(np.exp(p[5:]))])
        above = lambda i, k: 1.0 if k == 0 else 0.0 if k > top else 1 / (1 + np.exp(cuts[k - 1] - x[i] @ p[:4]))
        want = -np.mean([np.log(above(i, g) - above(i, g + 1)) for i, g in enumerate(grade)]) + 1e-3 * p[:4] @ p[:4] / 2
        value, slope = toxicity.loss(p, x, grade, top)
        assert np.isclose(value, want)
        for j in range(len(p)):
            step = np.zeros(len(p))
            step[j] = 1e-5
            assert np.isclose((toxicity.loss(p + step, x, grade, top)[0] - toxicity.loss(p - step, x, grade, top)[0]) / 2e-5, slope[j], atol=1e-6)


def test_severity_is_the_sum_of_thresholds():
    """Brute force: P(grade > k) for each cut from counts of the markers in the text."""
    texts = ["vilea vileb VILEA, x", "plain words", None, "", "vilea " * 5000]
    h, _, _ = toxicity.features(pa.array(["vilea vileb"]))
    markers = np.sort(h[:2])
    model = toxicity.Model(markers, np.array([0.7, 1.9]), np.array([1.0, 2.0, 4.5]))
    s, p = model.score(pa.array(texts))
    of = {x: k for k, x in enumerate(markers.tolist())}
    names = [of[x] for x in h[:2].tolist()]  # vilea, vileb
    counts = [(2, 1), (0, 0), (0, 0), (0, 0), (5000, 0)]
    for i, n in enumerate(counts):
        z = sum(model.weights[k] * np.log1p(c) for k, c in zip(names, n))
        each = [1 / (1 + np.exp(c - z)) for c in model.cuts]
        assert np.isclose(s[i], sum(each)) and np.isclose(p[i], each[0])


def test_grades_are_judged_out_of_fold():
    r = np.random.default_rng(3)
    toxic = r.random(400) < 0.4
    x = r.normal(size=(400, 3)) + toxic[:, None] * np.array([2.0, 1.0, 0.0])
    g = toxicity.grades(toxicity.out_of_fold(x, toxic, 150), toxic)
    assert (g[~toxic] == 0).all() and set(g[toxic]) == {1, 2, 3}
    share = np.bincount(g[toxic], minlength=4)[1:] / toxic.sum()
    assert (abs(share - 1 / 3) < 0.02).all()
    z = x @ np.array([2.0, 1.0, 0.0])
    assert z[g == 3].mean() > z[g == 2].mean() > z[g == 1].mean()
    # a document's own label does not move its own score
    other = toxic.copy()
    other[0] = ~other[0]
    assert np.isclose(toxicity.out_of_fold(x, toxic, 50)[0], toxicity.out_of_fold(x, other, 50)[0])
    # ties: one score, one grade
    even = np.arange(40) // 4 % 2 == 0
    assert len(set(toxicity.grades(toxicity.out_of_fold(np.ones((40, 2)), even, 50), even)[even])) == 1


def test_limit_has_the_best_f1():
    r = np.random.default_rng(9)
    for _ in range(20):
        toxic = r.random(60) < 0.3
        toxic[0] = True
        score = np.round(r.normal(size=60) + 2 * toxic, 1)  # with ties
        limit = toxicity.best_limit(score, toxic)
        f1 = lambda at: 2 * (toxic & (score >= at)).sum() / ((score >= at).sum() + toxic.sum())
        best = max(map(f1, score))
        assert np.isclose(limit, max(1 / (1 + np.exp(-s)) for s in score if f1(s) == best))


def test_the_limit_lies_in_a_gap():
    """What a limit parts stays parted, with room on both sides; nothing below it, or above it, leaves it alone."""
    score = np.array([3.0, 2.0, -1.0, -4.0])
    p = 1 / (1 + np.exp(-score))
    assert np.isclose(toxicity.between(score, p[1]), 1 / (1 + np.exp(-0.5)))
    assert toxicity.between(score, p[3]) == p[3] and toxicity.between(score, 1.0) == 1.0
    assert toxicity.parted(score, score > 0, np.array([0, 1, 0, 1]))[1::2] == (2, 2)


def test_expectation_maximisation_equals_a_plain_one():
    """Document by document, labeller by labeller."""
    r = np.random.default_rng(4)
    votes = r.integers(-1, 2, (300, 4))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, prior, rate = quality.estimate(patterns, counts, rounds=7)
    own = [0.1 if (v < 0).any() else 0.9 for v in votes]
    for _ in range(7):
        share = [(sum(1 - x for x in own) + 1) / 302, (sum(own) + 1) / 302]
        table = [[[(sum((x if c else 1 - x) for x, v in zip(own, votes) if v[k] == vote) + 1) / (sum((x if c else 1 - x) for x in own) + 3) for k in range(4)] for vote in (-1, 0, 1)] for c in (0, 1)]
        for i, v in enumerate(votes):
            low, high = (share[c] * np.prod([table[c][v[k] + 1][k] for k in range(4)]) for c in (0, 1))
            own[i] = high / (low + high)
    of = {tuple(p): x for p, x in zip(patterns.tolist(), post)}
    assert np.allclose([of[tuple(v)] for v in votes.tolist()], own) and np.allclose(rate, table) and np.allclose(prior, share)
    names = quality.accuracies(np.array([0.25, 0.75]), np.full((2, 3, 9), [[[0.5], [0.3], [0.2]], [[0.1], [0.2], [0.7]]]))
    assert names[0][0] == "plain_words" and np.isclose(names[0][1], 0.25 * 0.7 + 0.75 * 0.8) and np.isclose(names[0][2], (0.25 * 0.5 + 0.75 * 0.7) / 0.775)


def test_quality(spark, empty):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 8)))
    good = lambda: " ".join(" ".join(word() for _ in range(8)) + "." for _ in range(12))
    junk = [lambda: " ".join([word()] * 60), lambda: " ".join(word() + "###$$$" for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(60))]
    rows = [(i, good() if i % 4 else junk[(i // 4) % 3]()) for i in range(240)]
    docs = spark.createDataFrame([*rows, (None, good()), (900, None), (901, ""), (902, "word " * 100_000), (902, "word " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as votes", "2 as score", "3 as slots")
    work = quality.Graded(docs)
    got = work.rows().toPandas()
    assert len(got) == 245
    seen = got[got.doc_id < 240]
    assert (seen.keep == (seen.doc_id % 4 != 0)).mean() > 0.97
    # scores by the scorer's definition, on all features of whole texts
    w, _ = quality.shares(pa.array([t for _, t in rows]))
    doc, slot, value = quality.hashed(w)
    z = np.array([(value[doc == i] * work.weights[:-1][slot[doc == i]]).sum() + work.weights[-1] for i in range(240)])
    assert np.allclose(seen.sort_values("doc_id").score, 1 / (1 + np.exp(-z)), atol=1e-6)
    # a score at the limit is kept
    at = float(seen.score.iloc[0])
    assert work.rows(limit=at).filter(f"doc_id = {int(seen.doc_id.iloc[0])}").first().keep
    # labellers: the model's accuracies near the true ones
    truth, votes = seen.doc_id % 4 != 0, np.stack(seen.votes)
    for r_ in work.labellers().collect():
        v = votes[:, quality.LABELLERS.index(r_.labeller)]
        assert abs(r_.voted - (v != 0).mean()) < 0.05
        if (v != 0).sum() > 30:
            assert abs(r_.accuracy - ((v > 0) == truth)[v != 0].mean()) < 0.1
    assert quality.graded(empty).count() == 0 and quality.Graded(empty).labellers().count() == 0
