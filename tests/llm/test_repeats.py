"""Operators on repeats and near-duplicates against brute force, over awkward rows."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import common, neardup, shards, simhash, substring, suffixes
from siftwell.llm.components import components
from siftwell.llm.textbytes import Words, word_hashes


def numbered(rows):
    """Distinct documents in the order of id and text, those without id last; and how many rows each has."""
    n = Counter((r[0], r[1] or "") for r in rows)
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    return sorted(n, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]) if r[0] is None else r[1].encode())), n


def expected(rows, plain):
    docs, n = numbered(rows)
    return sorted((r for d, r in zip(docs, plain(docs)) for _ in range(n[d])), key=str)


def test_substring_equals_brute_force(docs, rows):
    got = sorted((tuple(r) for r in substring.removals(docs).collect()), key=str)
    assert got == expected(rows, brute.substring)
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == 0 for r in got)


def test_suffix_equals_brute_force(docs, rows):
    got = sorted((tuple(r) for r in suffixes.removals(docs).collect()), key=str)
    assert got == expected(rows, brute.suffix)
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == 0 for r in got)


def test_repeat_groups_have_all_occurrences(spark):
    passage = "".join(chr(97 + c) for c in np.random.default_rng(7).integers(0, 26, 140))
    docs = spark.createDataFrame([(1, "A" + passage + "B"), (2, "C" + passage + "D"), (3, "E" + passage + "F")], "doc_id long, text string")
    groups = {}
    for r in suffixes.repeat_groups(docs).collect():
        groups.setdefault(r.group_id, []).append((r.doc_id, r.start, r.length))
    assert [sorted(m) for m in groups.values()] == [[(1, 1, 140), (2, 1, 140), (3, 1, 140)]]


def test_repeat_groups_list_equal_contexts(spark, tmp_path):
    """Occurrences with the same bytes all around them: in many documents, in one shard only, in one document only."""
    rng = np.random.default_rng(9)
    some = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    wide, single, inside = some(300), some(300), some(300)
    texts = {i: f"{some(50)}{wide}{some(40)}" for i in range(20)}
    home = {r.id: r.s for r in spark.range(20, 99).selectExpr("id", "pmod(xxhash64(id), 4) as s").collect()}
    one = next(i for i in range(21, 99) if home[i] == home[20])
    texts |= {20: some(30) + single + some(9), one: some(9) + single + some(30), 100: some(9) + inside + some(70) + inside + some(5)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert suffixes.Repeats(docs).corpus.shards == 4
    groups, covered = {}, {i: set() for i in texts}
    for r in suffixes.repeat_groups(docs).collect():
        groups.setdefault(r.group_id, set()).add((r.doc_id, r.start, r.length))
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    for members in groups.values():
        doc, start, n = min(members)
        string = texts[doc][start : start + n]
        assert len(members) > 1 and members == {(i, p, n) for i, t in texts.items() for p in range(len(t)) if t.startswith(string, p)}
    strings = [texts[d][p : p + n] for m in groups.values() for d, p, n in [min(m)]]
    assert all(any(passage in s and len(s) < 310 for s in strings) for passage in (wide, single, inside))
    for i, t in texts.items():
        for passage in (wide, single, inside):
            assert all(set(range(p, p + 300)) <= covered[i] for p in range(len(t)) if t.startswith(passage, p))


def test_repeat_groups_equal_brute_force(spark):
    """Every group is a repeat with all its occurrences; every maximal repeat is a group, or lies in groups with its occurrences
    and others, where a part of it stands elsewhere too."""
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcd") for _ in range(n))
    long, short = some(400), some(25)
    texts = [some(40) + long + some(60), some(9) + long[50:390] + some(30), some(50) + long[100:300], short + some(30) + short, some(30) + short, long[:60] + some(4) + long[30:90], some(200)]
    got = {}
    for x in suffixes.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=20, seed=8).collect():
        got.setdefault(x.group_id, set()).add((x.doc_id, x.start, x.length))
    want = set()
    places = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - 19):
            places.setdefault(t[p : p + 20], []).append((d, p))
    todo = [m for m in places.values() if len(m) > 1]
    while todo:  # the right ends of repeats, longer and longer
        m = todo.pop()
        n = 20
        stack = [(m, n)]
        while stack:
            m, n = stack.pop()
            after = {}
            for d, p in m:
                after.setdefault(texts[d][p + n] if p + n < len(texts[d]) else (d, p), []).append((d, p))
            if len(after) > 1 and len({texts[d][p - 1] if p else (d,) for d, p in m}) > 1:
                want.add(frozenset((d, p, n) for d, p in m))
            stack += [(x, n + 1) for x in after.values() if len(x) > 1]
    for m in got.values():
        d, p, n = min(m)
        assert n >= 20 and m == {(i, q, n) for i, t in enumerate(texts) for q in range(len(t)) if t.startswith(texts[d][p : p + n], q)}
    for m in want:
        n = min(m)[2]
        covered = set()
        for g in map(sorted, got.values()):
            for d, p, k in g:
                shift = p - min(m)[1]
                if d == min(m)[0] and 0 <= shift and shift + k <= n and {(x, y + shift) for x, y, _ in m} <= {(x, y) for x, y, _ in g}:
                    covered |= set(range(shift, shift + k))
        assert covered == set(range(n)), (sorted(m), covered)
    assert len(want & {frozenset(m) for m in got.values()}) > len(want) / 2


def test_simhash_equals_brute_force(docs, rows):
    got = sorted(((r.doc_id is None, r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    own = [(r[0], r[1]) for r in rows if r[0] is not None]
    # rows with one id are one vertex only where their fingerprints link; the ids' smallest decides
    want = [((False, i), f, c) for i, f, c in brute.simhash(own)]
    want += [((True, None), f"{brute.fingerprint(r[1]):016x}", None) for r in rows if r[0] is None]
    assert got == sorted(want, key=lambda x: (x[0][0], x[0][1] or 0, x[1]))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_slices_equal_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 9, dtype=np.uint64)
    fp = np.array([int(base[rng.integers(9)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(300)], np.uint64)
    group = np.sort(rng.integers(0, 3, len(fp)))
    a, b = simhash.close(group, fp[:, None], radius)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
    if radius < 4:
        near = [(i, j) for i in range(300) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius]
        keys = simhash.band_keys(fp, radius)
        assert all(any(k[i] == k[j] for k in keys) for i, j in near)
        for n, key in enumerate(keys):  # what shares a crowded key shares one of those that part it
            parted = simhash.band_keys(fp, radius, n)
            assert all(any(k[i] == k[j] for k in parted) for i, j in near if key[i] == key[j])


def test_crowded_keys_lose_no_links(spark):
    rng = np.random.default_rng(2)
    fp = np.unique([0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)]).astype(np.uint64)
    classes = spark.createDataFrame(list(enumerate(fp.view(np.int64).tolist())), "vertex long, fp long")
    want = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2:
                low = min(want[i], want[j])
                want = [low if x in (want[i], want[j]) else x for x in want]
    for crowd in (4096, 10):
        found = {r.vertex: r.component for r in components(simhash.links(classes, 2, crowd)).collect()}
        assert [found.get(i, i) for i in range(len(fp))] == want
    assert 1 < len(set(want)) < len(fp)


def test_one_of_each_keeps_the_smallest(spark, docs):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:k] + [f"n{k}"] + words[k + 1 :]) for k in (50, 90, 130)]
    far = " ".join(f"v{i}" for i in range(200))
    rows = [(5, near[0], "a"), (4, near[1], "b"), (9, near[2], "c"), (1, far, "d"), (7, far, "e"), (8, None, "f"), (None, far, "g"), (2, "", "h")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _gone string")).collect()
    assert sorted(r._gone for r in got) == ["b", "d", "g", "h"]
    assert got[0].asDict().keys() == {"doc_id", "text", "_gone"}


def linked(texts, size=5, similarity=0.8):
    """The smallest index that each text reaches over pairs of that exact Jaccard similarity."""
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def kept(spark, texts):
    found = {r.doc_id: r.kept_id for r in neardup.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [found.get(i, i) for i in range(len(texts))]


def test_near_duplicates_around_the_threshold_equal_brute_force(spark):
    """Failed pairs of high estimates must not take the place of true links."""
    rng = np.random.default_rng(3)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        for k in range(60):
            text = list(base)
            for i in rng.choice(400, 5 + g % 2, replace=False):
                text[i] = f"new{g}x{k}x{i}"
            texts.append(" ".join(text))
    want = linked(texts)
    assert 3 < len(set(want)) < 150
    assert kept(spark, texts) == want


def test_near_duplicates_with_repeats_equal_brute_force(spark):
    """A line standing many times, or a run of one word, changes fingerprints by weight but not the sets."""
    texts = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(100)]
        line = " ".join(f"g{g}l{i}" for i in range(10))
        texts += [" ".join([*base, line]), " ".join([*base, *[line] * 11])]
        base = [f"g{g}v{i}" for i in range(104)]
        texts += [" ".join(base), " ".join([*base[:50], *["run"] * 64, *base[50:]])]
    want = linked(texts)
    assert len(set(want)) == 60
    assert kept(spark, texts) == want


def test_cut_texts_leave_others_as_they_are(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start {passage} end\n", 1), (2, f"other\n{passage}", 2), (3, "  clean\ttext \n", 3), (4, None, 4), (None, passage, 5), (3, "  clean\ttext \n", 3)]
    got = sorted((r.content, r.text) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, content int")).collect())
    assert got == [(1, "start end"), (2, "other"), (3, "  clean\ttext \n"), (3, "  clean\ttext \n"), (4, None), (5, "")]


def test_other_columns_come_through_the_cut(spark):
    """Names that stand for something inside, nested values, and columns in any order."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([([1, 2], f"x {passage}", 7, "s", 5), (None, f"y {passage}", 8, None, None)], "own array<int>, text string, doc_id int, blank string, shard int")
    got = substring.without_repeats(docs)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=str) == [(None, "y", 8, None, None), ([1, 2], "x", 7, "s", 5)]


def test_automaton_decides(spark):
    """Windows are candidates only where the automaton stops."""
    w = Words(pa.array(["a b c d e f", "x c d e y", None, "c d", "d e c d e"]))
    hashes = word_hashes(w)
    own = substring.letters(hashes)
    cde = own[2:5].tobytes()
    assert substring.located(w, hashes, [cde], 3).tolist() == [2, 7, 15] and not len(substring.located(w, hashes, [], 3))
    assert set(substring.located(w, hashes, [cde, own[:3].tobytes()], 3).tolist()) == {0, 2, 7, 15}


def test_sizes_are_measured_where_sources_do_not_know_them(spark, docs):
    few = spark.createDataFrame([(1, "a" * 1000), (2, None)], "doc_id long, text string")
    assert common.source_bytes(few) < 1 << 20 and common.task_count(few) == 4
    assert common.source_bytes(few.join(few.select("doc_id"), "doc_id")) < 1 << 20
    assert shards.Corpus(few.union(few)).shards == 4


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]"])
def test_folders_must_be_shared(master):
    with pytest.raises(ValueError):
        common.own_dir(master, "x")


def test_a_hot_content_meets_its_rows_dealt_out(spark):
    rows = spark.range(1000).selectExpr("case when id % 3 = 0 then 'hot' when id % 100 = 1 then concat('pair', id % 200) else cast(id as string) end as content", "id as doc_id")
    got = {r.doc_id: r.rep for r in common.copies(rows, "content", "doc_id").collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r.content, []).append(r.doc_id)
    assert got == {i: min(m) for m in want.values() if len(m) > 1 for i in m}


def test_empty_tables(empty):
    for f in (substring.removals, suffixes.removals, simhash.near_duplicates, neardup.one_of_each, substring.without_repeats, suffixes.repeat_groups):
        assert f(empty).count() == 0


def test_least_depends_on_content_only():
    h = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    joined = np.concatenate([h[100:200], h[:50], h[100:200]])
    at = shards.least(joined, 17)
    assert [a - i for i, a in enumerate(at[:84])] == [a - i for i, a in enumerate(at[150:234], 150)]
    assert all(joined[a] >> np.uint64(24) == (joined[i : i + 17] >> np.uint64(24)).min() for i, a in enumerate(at))


def test_words_made_to_collide_in_polynomials_are_told_apart(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever its base and letters."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    shared = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"x {shared} {one}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.removals(docs).collect()) == [(1, 35), (2, 0), (3, 35)]
    w = Words(pa.array([f"{one} {two} {one}"]))
    h = word_hashes(w)
    assert h[0] == h[2] != h[1] and word_hashes(w, 1)[0] != h[0]
    from siftwell.llm import quality, toxicity

    found, doc, _ = toxicity.features(pa.array([one, two]))
    assert not set(found[(doc == 0)][:1]) & set(found[doc == 1][:1]) and quality.word_hashes is word_hashes


def templated(many, changes, seed, words=60, line=None):
    """Texts of one template, each with some words of its own."""
    r = random.Random(seed)
    base = line or [f"t{i}" for i in range(words)]
    out = []
    for k in range(many):
        own = list(base)
        for i in r.sample(range(len(own)), changes(k, r)):
            own[i] = f"x{r.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("crowd", [10, 2048])
def test_near_duplicates_of_crowded_keys_equal_brute_force(spark, crowd):
    """Documents of one template around the limit, in groups that pass it or not; recall is 1 whichever way they meet."""
    texts = templated(120, lambda k, r: r.randint(0, 4), 3) + templated(60, lambda k, r: 2, 4, words=150)
    rows = list(enumerate(texts)) + [(7, texts[7]), (500, "only four words here"), (501, ""), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in range(len(texts)) if find(i) != i}
    got = {r.doc_id: r.kept_id for r in neardup.duplicates(df, crowd=crowd).collect()}
    assert {k: v for k, v in got.items() if k < 500} == want and 20 < len(want) < len(texts) - 20


def test_prefixes_lose_no_pair_and_part_templates(spark):
    texts = templated(80, lambda k, r: (1, 9)[k % 2], 8, words=100)
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    met = {}
    for r in neardup.prefixes(df, 5, 0.8).collect():
        met.setdefault(r.key, set()).add(r.vertex)
    together = {(a, b) for g in met.values() for a in g for b in g if a < b}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = {(a, b) for b in range(80) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike and alike <= together
    assert not any(a % 2 and b % 2 for a, b in together)  # many words of their own: they do not meet
