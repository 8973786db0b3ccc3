"""Source divergence, LM scores and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import codes, divergence, lm
from tessera.llm.trie import Monotone, Trie, coded


# ---- vector codes -----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=70), st.lists(st.tuples(*[st.integers(-4, 4)] * 3), min_size=1, max_size=30))
def test_trees_find_the_least_of_equally_near_entries(entries, points):
    at, d = codes.Tree(np.array(entries)).nearest(np.array(points, np.int64))
    for p, i, x in zip(points, at, d):
        want = min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(entries))
        assert (x, i) == want


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    near = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, vs in own.items():
                books[p][k] = [sum(x) // len(vs) for x in zip(*vs)]
    out = []
    for i, v in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_of_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) + rng.random() / 50 for _ in range(8)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(100 + i, list(rows[3][1]), 7) for i in range(90)]  # one vector many times
    rows += [rows[5], rows[5], (None, list(rows[7][1]), None)]  # repeated rows, a row without id
    rows += [(200, None, 1), (201, [0.0] * 7 + [None], 1), (202, [math.nan] + [0.0] * 7, 1), (203, [math.inf] + [0.0] * 7, 1)]
    made = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, VEC_ID string, code double").repartition(5)
    got = codes.compressed(made, 4, 16, 3).collect()
    f32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    want, digest = plain_codes(f32, 4, 16, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key) and {r.codebooks_sha256 for r in got} == {digest}
    by = Counter()
    label = {i: lab for i, _, lab in rows}
    for i, _, e in want:
        by[label[i]] += e
    assert all(r.label_error == by[label[r.vec_id]] for r in got)


def test_codes_that_are_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 4, 1)], kind)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0], 1), (3, [1e9, 0.0, 0.0, 0.0], 1), (4, [1.0, 2.0, 3.0, 4.5], 2), (5, [], 2)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compressed(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == ("00000000", 0, 0) and got[4][0] == "00000001" and got[2] == (None, None, 0) and got[3] == (None, None, 0) and got[5] == (None, None, 0)
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], kind))


# ---- source divergence ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least):
    n, lang_n, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n[lang or "", source or ""].update(terms)
        lang_n[lang or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        q, own = share(lang_n[lang]), {g[1]: share(n[g]) for g in groups if g[0] == lang}
        for s, p in own.items():
            pairs = sorted(((-sum(f(p[t], o[t]) for t in kept), x) for x, o in own.items() if x != s), key=lambda r: (r[0], r[1].encode()))
            terms = sorted(((-f(p[t], q[t]), t) for t in kept if n[lang, s][t] and p[t] > q[t]), key=lambda r: (r[0], r[1].encode()))[:10]
            for part, rows_ in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x, -v, i) for i, (v, x) in enumerate(rows_, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, cell", [(1 << 18, 1 << 21), (7, 40)])
def test_divergence_equals_brute_force(spark, shard, cell):
    rng = random.Random(2)
    words = ["Alpha", "alpha", "bêta", "γάμμα", "délta", "x", "it's", "e-mail", "日本語", "Ωmega", "tie", "eit", "İstanbul", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words[: 6 + 2 * (i % 14)]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "ß", None])) for i in range(160)]
    rows += [("alpha " * 3000, "en", "s0"), ("", "en", "empty"), (None, "en", "null"), ("12 34", "fr", "a"), ("seldom", "fr", "b"), ("seldom", "fr", "b"), ("lonely " * 12, "it", "one")]
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, TEXT int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.divergence(made, 5, shard, cell).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 5)
    assert divergence.divergence(made.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        v = rng.randrange(1, 10 ** rng.randrange(1, 9))
        total = rng.randrange(10 ** rng.randrange(1, 15))
        c = rng.randrange(total + 1)
        assert divergence.shares(np.array([c]), np.int64(total), np.int64(v))[0] == 1 + 10**9 * (c + 2) // (total + 2 * v)


def test_every_two_cells_meet_once(spark):
    for n in (6, 8, 14):
        met = Counter()
        for turn in range(n - 1):
            rows = spark.range(n).selectExpr("cast(id as int) cell").withColumn("other", divergence._opponent(turn, n)).collect()
            assert all(rows[r.other].other == r.cell != r.other for r in rows)
            met.update(frozenset((r.cell, r.other)) for r in rows)
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {2}


# ---- LM scores --------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=80), st.lists(st.integers(0, 1 << 40), min_size=1, max_size=20))
def test_sequences(numbers, asked):
    numbers = sorted(numbers)
    s = Monotone(*(lambda h, low, high: (*h.view("<i8").tolist(), low, high))(*Monotone.build(np.array(numbers, np.int64))))
    assert s.get(np.arange(len(numbers))).tolist() == numbers
    at, same = s.successor(np.array(asked + numbers, np.int64))
    for x, i, ok in zip(asked + numbers, at, same):
        want = next((k for k, y in enumerate(numbers) if y >= x), len(numbers))
        assert i == want and ok == (want < len(numbers) and numbers[want] == x)


def test_trie_finds_children_of_their_own_context():
    rng = random.Random(4)
    grams = sorted({(rng.randrange(1, 9), rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(90)})
    two = sorted({g[:2] for g in grams} | {(3, 11)})
    first = sorted({g[0] for g in two})
    prob = lambda rows: coded(np.array([0.001 * (i + 1) for i in range(len(rows))]))
    levels = [(np.array([first.index(a) for a, _ in two]), np.array([b for _, b in two]), prob(two), prob(two)), (np.array([two.index(g[:2]) for g in grams]), np.array([g[2] for g in grams]), prob(grams), prob(grams))]
    trie = Trie(Trie.build(np.array(first), levels), 3)
    for a in range(0, 10):
        for b in range(0, 13):
            at = trie.children(2, trie.firsts(np.array([a])), np.array([b]))
            assert at[0] == (two.index((a, b)) if (a, b) in two else -1)
            for c in range(0, 13):
                got = trie.children(3, at, np.array([c]))[0]
                assert got == (grams.index((a, b, c)) if (a, b, c) in grams else -1)


def tokens(text):
    return re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def plain_scores(rows, order):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    count = [None] + [Counter() for _ in range(order)]
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            for n in range(1, order + 1):
                count[n].update(zip(*[w[k:] for k in range(n)]))
    total, v = sum(count[1].values()), len(count[1])
    quantised = lambda x: 10 ** (-round(-math.log10(x) * 2048) / 2048) if x else 0.0
    out = []
    for i, t in rows:
        w, base, score, known = tokens(t), 0.0, 0.0, 0
        for k, x in enumerate(w):
            c = count[1][(x,)]
            known += c > 0
            p = (c + 0.5) / (total + 0.5 * (v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                context = tuple(w[k - n + 1 : k])
                if k - n + 1 >= 0 and (c := count[n - 1][context]):
                    new = float(lm.types(np.array([c]), n - 1)[0])
                    left = new / (c + new)
                    p = quantised(count[n][(*context, x)] / (c + new)) + (left if n == 2 else quantised(left)) * p
            score += math.log10(p)
        out.append((i, held(i), len(w), known, total, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 600)
    monkeypatch.setattr(lm, "_PIECE", 64)
    rng = random.Random(5)
    words = ["The", "the", "of", "a", "Été", "été", "x y", "日本", "end.", "\x1fodd", "w" * 150] + [f"u{i}" for i in range(30)]
    rows = [(i, rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(40)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "the of a"), (3, rows[3][1]), (3, "another text of the same id"), (205, "the of " * 900), (206, "unseen1 unseen2 the"), (207, "w" * 4000)]
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, TEXT string, score int").repartition(3)
    got = sorted(map(tuple, lm.scores(made, order, 300).collect()), key=str)
    want = sorted(plain_scores(rows, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def test_scores_without_rows_to_learn_from(spark):
    kind = "doc_id long, text string"
    assert lm.scores(spark.createDataFrame([], kind)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.scores(spark.createDataFrame([(only, "some words")], kind)).collect()
    assert [tuple(r) for r in got] == [(only, True, 3, 0, 0, 0.0, 0.0)]


def test_probabilities_after_a_context_sum_to_one(spark):
    """Over all known words, the end and one unknown word, for contexts that were seen and not, but for what rounding does."""
    rng = random.Random(6)
    train = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))) for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    ids = iter(i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1)
    contexts = ["a b", "f e", "zz a", "b zz", "c"]
    asked = {(c, w): next(ids) for c in contexts for w in [*"abcdef", "unknown", None]}
    rows = train + [(i, c if w is None else f"{c} {w}") for (c, w), i in asked.items()]
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = {r[0]: r[6] for r in plain_scores(rows, 3)}
    assert all(math.isclose(got[i], plain[i], rel_tol=1e-9) for i in asked.values())
    # P(w | context) = P(context, w, end) / P(context, end) * P(end | context) / P(end | context, w); the ends' come from the plain counts
    tri, bi, uni = Counter(), Counter(), Counter()
    for _, t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(w, w[1:]))
        tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)

    def p(w, x, y):  # without rounding
        q = (uni[y] + 0.5) / (n + 0.5 * (v + 1))
        for c, k, order in ((uni[x], bi[x, y], 1), (bi[w, x], tri[w, x, y], 2)):
            if c:
                new = float(lm.types(np.array([c]), order)[0])
                q = (k + new * q) / (c + new)
        return q

    for c in contexts:
        w, x = ([None] + c.split())[-2:]
        assert math.isclose(sum(p(w, x, y) for y in [*"abcdef", "\n", "unknown"]), 1.0, rel_tol=1e-9)
        end = got[asked[c, None]]
        total = 10 ** (math.log10(p(w, x, "\n")))
        for y in [*"abcdef", "unknown"]:
            total += 10 ** (got[asked[c, y]] - end) * p(w, x, "\n") / p(x, y, "\n")
        assert abs(total - 1) < 0.01


def test_held_out_texts_are_foreseen_better_than_by_counts_alone(spark, sf_dir):
    rows = lm.op12_lm_scores(spark, sf_dir).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > rows.b * 0.95


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_vector_codes"])
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    import duckdb

    from tessera.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
