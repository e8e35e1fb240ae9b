"""Divergence of sources, chat formatting and clustering against plain versions, over awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import chat, clustering, divergence


# --- source divergence
def plain_audit(rows, least, most):
    """rows: (text, lang, source)."""
    docs = [([t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")], lang or "", source or "") for x, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        in_docs = Counter(t for terms, _, _ in own for t in set(terms))
        kept = [t for t, n in in_docs.items() if n >= least]
        counts = defaultdict(Counter)
        for terms, _, source in own:
            counts[source].update(t for t in terms if in_docs[t] >= least)
        every = Counter(t for terms, _, _ in own for t in terms if in_docs[t] >= least)
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[: most if part == "term" else None])]
    return sorted(out)


AUDIT = "doc_id long, text string, lang string, source string, term string, n long, one int, `Value` int"


@pytest.mark.parametrize("least, most, entries", [(1, 50, 200_000), (3, 2, 5), (99, 5, 200_000)])
def test_divergence_equals_brute_force(spark, monkeypatch, least, most, entries):
    texts = ["The cat SAT on the mat", "the CAT; cat's ÉTÉ été", "", None, "1 2 3 @ [\\] `", "ß straße STRASSE naïve", "the the the " * 400, "a" * 5000 + " b", "cat", "dog dog", "中文 字 the", "mat mat mat on"]
    rows = [(i, t, lang, source, "x", 1, 2, 3) for i, (t, lang, source) in enumerate((t, lang, f"s{(j + k) % 3}" if k else None) for j, t in enumerate(texts) for k, lang in enumerate(("en", None, "fr")))]
    rows += [rows[3], rows[3], (None, "only here", "de", "alone", None, None, None, None), (None, None, "de", "empty", None, None, None, None), (None, "", "xx", "none", None, None, None, None)]
    monkeypatch.setattr(divergence.counted, "__defaults__", (entries,))
    got = sorted(map(tuple, divergence.audited(spark.createDataFrame(rows, AUDIT).repartition(3), least, most).collect()))
    assert got == plain_audit([r[1:4] for r in rows], least, most)
    assert ("de", "empty", "pair", "alone") in {r[:4] for r in got}
    if least == 99:
        assert {r[4] for r in got} == {0} and {r[2] for r in got} == {"pair"}


def test_histograms_have_all_cells(spark):
    """Multiplicities of a pair sum up to the kept terms, zeros on either side and on both included."""
    rows = [("a b c c", "en", "x"), ("a d d", "en", "y"), ("e", "en", "z"), ("", "en", "w")]
    audit = divergence.Audit(spark.createDataFrame(rows, "text string, lang string, source string"), 1)
    cells = defaultdict(dict)
    for r in audit.histograms().collect():
        cells[r.one, r.two][r.a, r.b] = r.many
    assert cells["x", "y"] == {(1, 1): 1, (1, 0): 1, (2, 0): 1, (0, 2): 1, (0, 0): 1}
    assert cells["w", "z"] == {(0, 1): 1, (0, 0): 4} and all(sum(c.values()) == 5 for c in cells.values()) and len(cells) == 6


def test_divergence_of_nothing_and_of_numbers_that_are_large(spark):
    assert divergence.audited(spark.createDataFrame([], AUDIT)).count() == 0
    n, total, terms = 10**13, 10**15, 10**9
    got = spark.range(1).select(divergence.share(*(divergence.F.lit(x) for x in (n, total, terms)))).first()[0]
    assert got == 1 + 1000000000 * (n + 5) // (total + 5 * terms)


def test_terms_of_long_texts_are_cut_at_blanks():
    data = b" ".join(b"x" * (i % 50 + 1) for i in range(5000)) + b"y" * 3000
    assert [t for p in divergence.pieces_of(data, 100) for t in p.split()] == data.split()


# --- chat formatting
PART = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]", "[ROLE]", "[TEXT] ", "[/ROLE]", "\\", "<", "[", " ", "a", "é", "\n", chat.PROBES[0], "𝄞"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PART), PART), max_size=6))
def test_template_can_be_read_back(turns):
    text = chat.instruct(turns)
    assert chat.turns_of(text) == turns
    assert all(chat.unescape(chat.escape(t)) == t and not chat.CONTROL.search(chat.escape(t)) for _, t in turns)
    s = chat.located(chat.instruct, turns)
    assert s.text == text and s.rewritten_at is None and (not turns or (s.turns[0][0], s.turns[-1][1]) == (3, len(text)))
    assert all(a[1] == b[0] for a, b in zip(s.turns, s.turns[1:]))
    assert [chat.unescape(text[i:j]) for i, j in s.loss] == [t for r, t in turns if r == "assistant"]


def stripping():
    """A template that drops the thoughts of all answers but the last; made here, so that workers get it by value."""

    def render(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"<{r}>{t if i == last else re.sub('{.*?}', '', t)}\n" for i, (r, t) in enumerate(turns))

    return render


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "q"), ("assistant", "{think}a"), ("user", "q2"), ("assistant", "{more}b")]
    s = chat.located(stripping(), turns)
    assert s.rewritten_at == 4 and s.text == stripping()(turns) and len(s.turns) == 3
    plain = [("user", "q"), ("assistant", "a"), ("assistant", "")]
    s = chat.located(stripping(), plain)
    assert s.rewritten_at is None and [s.text[i:j] for i, j in s.loss] == ["a", ""]
    # a template that trims texts: the frame does not fit, nothing is under the mask
    s = chat.located(lambda turns: "".join(f"[{t.strip().upper()}]" for _, t in turns), [("assistant", "  x")])
    assert len(s.loss) == 1


CHAT = "conv_id long, turn long, role string, text string, none int, `N_TURNS` int"


def test_conversations_equal_brute_force(spark):
    rows = [(i % 7, i // 7, ["user", "assistant", "system", "tool"][(i * 5 // 7) % 4], f"text {i} [INST] \\ </s>" * (i % 3), 1, 2) for i in range(60)]
    rows += [(3, 1, None, None, 1, 1), (3, 1, "assistant", "b", 1, 1), (3, 1, "assistant", "b", 1, 1), (3, None, "assistant", "first", 1, 1), (None, 1, "user", "no", 1, 1), (None, 0, "assistant", "id", 1, 1), (0, 0, "user", "id zero", 1, 1), (9, 0, "assistant", "x" * 300_000, 1, 1)]
    rows += [(11, i, "assistant" if i % 2 else "user", f"turn {i}", 1, 1) for i in range(300)]
    df = spark.createDataFrame(rows, CHAT).repartition(3)
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(chat.instruct(turns)))
    got = chat.audited(chat.with_planted(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert got[0].__fields__ == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert chat.audited(spark.createDataFrame([], CHAT)).count() == 0
    flagged = chat.with_id(chat.formatted(df.filter("conv_id = 11"), stripping())).first()
    assert flagged.rewritten_at is None and len(flagged.turn_start) == 300


# --- centroid clustering
def plain_lloyd(rows, many, rounds, size, scale, seed):
    vectors = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [v for _, v in named[:many]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in vectors]
        for k in set(at):
            own = [v for (_, v), a in zip(vectors, at) if a == k]
            centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *near(v)) for i, v in vectors]
    inertia = Counter()
    for _, d, k in last:
        inertia[k] += d
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, k, long(d), long(inertia[k]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, small int, `Cluster` int"


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_equal_brute_force(spark, wide):
    import random

    r = random.Random(3)
    rows = [(i, [r.gauss(i % 4, 0.4) for _ in range(3)]) for i in range(120)]
    rows += [(500 + i, [0.25, -0.5, 1.0]) for i in range(40)]  # a very common vector
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (None, None), (700, None), (701, []), (702, [1.0, 2.0]), (703, [1.0, None, 2.0]), (704, [1.0, math.nan, 2.0]), (705, [math.inf, 1.0, 2.0]), (706, [1.0, 2.0, 3.0, 4.0]), (2**60 + 1, [-1e-300, 0.0, -0.0])]
    if wide:
        rows += [(800, [1e300, 0.0, 1.5]), (801, [1e300, 1.0, -2.5]), (802, [7e4, -7e4, 0.1]), (803, [-1.7976931348623157e308, 5.0, 1e12])]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], VECTORS).repartition(3)
    many = 3 if wide else 5
    got = sorted(map(tuple, clustering.clustered(df, many, 4, 3, 1024, 3).collect()), key=str)
    assert got == plain_lloyd(rows, many, 4, 3, 1024, 3)
    assert len({g[1] for g in got}) > 1


def test_clusters_of_few_vectors_and_of_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.cluster, r.distance) for r in clustering.clustered(few, 8, 2, 2).collect()}
    assert got[1] == got[2] and {g[1] for g in got.values()} == {0} and got[3] != got[1]
    assert clustering.clustered(few.filter("false"), size=2).count() == 0 and clustering.clustered(few, size=3).count() == 0
    far = spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert sorted(((r.distance, r.inertia) for r in clustering.clustered(far, 1, 0, 1).collect()), key=str) == [(0, None), (None, None)]
    heard = []
    whole = clustering.integers(few, 2, 1024)
    clustering.fitted(whole, clustering.first(whole, 2, 3, 2), 2, 2, lambda n, inertia: heard.append((n, inertia)))
    assert [n for n, _ in heard] == [0, 1] and heard[1][1] <= heard[0][1]
