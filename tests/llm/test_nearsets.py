import random

import numpy as np
import pytest

from millrace.llm import neardup, overlap
from millrace.llm.nearset import components, prefix_pairs
from millrace.llm.shingles import ICWS, MinHash, shingles, words

WORDS = [f"w{i}" for i in range(900)]


def likeness(a, b, k=3):
    s = [frozenset(zip(*(w[i:] for i in range(k)))) for w in (words(a), words(b))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1])) if min(len(words(a)), len(words(b))) >= 8 else 0.0


def texts(n=60, seed=2):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(30, 120))) for _ in range(n)]
    out = list(base)
    for t in base[:40]:
        ws = t.split()
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(ws))
            ws[i : i + rng.choice((0, 1))] = [rng.choice(WORDS)]
        out.append(", ".join(ws).upper() + ".")
    out += [base[0], base[0] + "!", "one two three", "", "  ", None, "x " * 30_000, "x " * 20_000]
    return out


def test_words_and_shingles():
    assert words("It's 4.5 m_2, É!") == ["it", "s", "4", "5", "m", "2", "é"]
    h, n = shingles(words("a b c a b c a b"), 3)
    assert len(h) == 3 and sum(n) == 6


def test_codes_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, 120).astype(np.uint64), rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = np.unique(x), np.unique(np.concatenate([x[40:], y]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    fp = MinHash(2000, 1)
    assert abs((fp(a)[0] == fp(b)[0]).mean() - j) < 0.05
    w = lambda h: 1.0 + (h % np.uint64(7)).astype(float)
    cw = ICWS(2000, 1)
    both = np.intersect1d(a, b)
    jw = w(both).sum() / w(np.union1d(a, b)).sum()
    assert abs((cw(a, w(a)) == cw(b, w(b))).mean() - jw) < 0.05


@pytest.mark.parametrize("most", [0, 10**6])
def test_overlaps_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(overlap, "BLOCK_PAIRS", most)
    t = texts()
    train = [(f"t{i}", x, 1) for i, x in enumerate(t[:60])] + [("t0", t[0], 2)]
    val = [(f"v{i}", x, 1) for i, x in enumerate(t[60:])]
    f = lambda rows: spark.createDataFrame(rows, "id string, text string, split int")
    got = {(r["eval_id"], r["train_id"]) for r in overlap.cross_split_overlaps(f(train), {"val": f(val), "test": f(val).limit(0)}, k=3, threshold=0.6).pairs().collect()}
    want = {(v, a) for v, y, _ in val for a, x, _ in train if x and y and likeness(x, y) >= 0.6}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("most", [1, 1000])
def test_groups_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "BUCKET", most)
    t = texts(seed=4)
    rows = [(f"d{i}", x, None, 1) for i, x in enumerate(t)] + [("d0", t[0], None, 1)]
    df = spark.createDataFrame(rows, "document_id string, text string, group string, rid int")
    got = {}
    for r in neardup.near_duplicate_groups(df, "document_id", "text", k=3, threshold=0.6).collect():
        got.setdefault(r["group"], set()).add(r["id"])
    parent = {r[0]: r[0] for r in rows if r[1] and len(words(r[1])) >= 8}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    text = {r[0]: r[1] for r in rows}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if root(a) != root(b) and likeness(text[a], text[b]) >= 0.6:
                parent[root(a)] = root(b)
    want = {}
    for a in ids:
        want.setdefault(root(a), set()).add(a)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", "short text")]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string")
    assert neardup.near_duplicate_groups(df, "id", "text").count() == 0
    assert overlap.cross_split_overlaps(df, {"val": df}).pairs().count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[j] == 100 for j in range(100, 160)) and len(got) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defaults_take_five_words_and_four_fifths(spark):
    a = " ".join(WORDS[:40])
    b = " ".join(WORDS[:38] + ["other", "words"])
    df = spark.createDataFrame([("a", a), ("b", b), ("c", " ".join(WORDS[:20] + WORDS[100:120]))], "id string, text string")
    groups = {r["id"]: r["group"] for r in neardup.near_duplicate_groups(df, "id", "text").collect()}
    assert groups["a"] == groups["b"] != groups["c"]


def test_group_names_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts(seed=6))], "id string, text string")
    got = [sorted(map(tuple, neardup.near_duplicate_groups(df.repartition(n), "id", "text", k=3, threshold=0.6).collect())) for n in (1, 7)]
    assert got[0] == got[1] and all(g <= i for i, g in got[0])


def test_weighted_verification_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BANDS", 256)
    stock = " ".join(WORDS[:12])
    rng = random.Random(8)
    t = [f"{stock} {' '.join(rng.choices(WORDS, k=9))}" for _ in range(12)]
    t += [x + " and more" for x in t[:6]] + [x + " " + " ".join(x.split()[-4:] * 3) for x in t[6:9]]
    df = spark.createDataFrame([(f"d{i:02}", x) for i, x in enumerate(t)], "id string, text string")
    got = {r["id"]: r["group"] for r in neardup.near_duplicate_groups(df, "id", "text", k=3, threshold=0.6, weighted=True).collect()}
    sets = [shingles(words(x), 3) for x in t]
    share = {}
    for h, _ in sets:
        for s in h.tolist():
            share[s] = share.get(s, 0) + 1 / len(t)
    weight = [{s: np.log1p(1 / max(share[s], 1 / 16)) * (1 + np.log(n)) for s, n in zip(h.tolist(), c.tolist())} for h, c in sets]
    want = list(range(len(t)))
    for i, a in enumerate(weight):
        for j, b in enumerate(weight[:i]):
            low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if low / (sum(a.values()) + sum(b.values()) - low) >= 0.6:
                want = [want[j] if x == want[i] else x for x in want]
    assert [got[f"d{i:02}"] for i in range(len(t))] == [f"d{min(j for j, y in enumerate(want) if y == x):02}" for x in want]
    assert 6 < len(set(want)) < len(t)


def test_a_text_in_a_third_of_the_rows(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[:39] + ["other"])
    df = spark.createDataFrame([(f"d{i:04}", a if i % 3 else b) for i in range(3000)], "id string, text string")
    assert neardup.near_duplicate_groups(df, "id", "text").select("group").distinct().count() == 1
    got = overlap.cross_split_overlaps(df, {"val": df.limit(1).select("id", "text")})
    assert got.links.count() == 2 and got.pairs().count() == 3000


def test_tables_on_the_way_are_deleted(spark):
    from millrace import session

    before = len(session._cut_paths)
    df = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts(20))], "id string, text string")
    got = neardup.near_duplicate_groups(df, "id", "text", k=3, threshold=0.6)
    assert len(session._cut_paths) == before + 1 and got.count() > 0


def test_prefix_filtering_has_every_pair(spark):
    rng = random.Random(12)
    stock = list(range(1000, 1040))
    sets = [sorted({*stock, *rng.sample(range(300), rng.randrange(5, 60))}) for _ in range(60)]
    for weighted in (False, True):
        w = [[1.0 + (x % 7) if weighted else 1.0 for x in s] for s in sets]
        df = spark.createDataFrame([(i, s, v if weighted else None) for i, (s, v) in enumerate(zip(sets, w))], "rid long, sh array<long>, w array<double>")
        got = {tuple(r) for r in prefix_pairs(df, df, 0.6, "rid").collect()}
        size = [dict(zip(s, v)) for s, v in zip(sets, w)]
        for i, a in enumerate(size):
            for j, b in enumerate(size):
                low = sum(a[x] for x in a.keys() & b.keys())
                assert low / (sum(a.values()) + sum(b.values()) - low) < 0.6 or (i, j) in got
