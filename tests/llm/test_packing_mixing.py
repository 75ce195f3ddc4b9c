import bisect
import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing, packing


def one_by_one(capacity, sizes):
    rest, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rest, s)
        left = rest.pop(i) if i < len(rest) else capacity
        n += left == capacity
        bisect.insort(rest, left - s)
    return n, rest


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.randint(3, 200)
    sizes = [min(cap, max(1, int(rng.expovariate(3 / cap)) + 1)) for _ in range(rng.randrange(0, 500))]
    plan, bins = packing.best_fit_decreasing(cap, Counter(sizes))
    want, rest = one_by_one(cap, sizes)
    fill, ranks = Counter(), defaultdict(list)
    for size, rank, items, per, first, offset in plan:
        ranks[size] += range(rank, rank + items)
        for i in range(items):
            assert offset + i % per * size + size <= cap
            fill[first + i // per] += size
    assert bins == want and sorted(cap - f for f in fill.values()) == rest
    assert all(sorted(r) == list(range(n)) for r, n in ((ranks[s], c) for s, c in Counter(sizes).items()))


def settings(spark, caps):
    return spark.createDataFrame(list(caps.items()), "setting string, capacity int")


@pytest.mark.parametrize("shard", [3, 10**6])
def test_pack(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "RANK_SHARD", shard)
    rng = random.Random(1)
    rows = [(f"i{i}", rng.choice([3, 5, 5, 40, 64, 65, 200]), "z", 1) for i in range(200)] + [("i0", 5, "z", 1), ("none", None, "z", 1), ("zero", 0, "z", 1)]
    df = spark.createDataFrame(rows, "id string, n int, setting string, bin int")
    got = packing.pack(df, "id", "n", settings(spark, {"a": 64, "b": 100, None: 5, "c": 0})).collect()
    assert {r["setting"] for r in got} == {"a", "b"}
    for s, cap in (("a", 64), ("b", 100)):
        mine = [r for r in got if r["setting"] == s]
        used = defaultdict(list)
        for r in mine:
            if r["bin"] is not None:
                used[r["bin"]].append((r["offset"], r["offset"] + r["size"]))
        for spans in used.values():
            spans.sort()
            assert spans[-1][1] <= cap and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(r["size"] for r in mine) == sum(r[1] or 0 for r in rows)
        assert {r["id"] for r in mine if r["piece"] > 0} == {r[0] for r in rows if (r[1] or 0) > cap}
        pieces = [min(cap, n - k * cap) for _, n, _, _ in rows for k in range(-(-(n or 0) // cap)) if n]
        assert len(used) == one_by_one(cap, pieces)[0]
        assert sum(r["bin"] is None for r in mine) == 2


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "id string, n int")
    assert packing.pack(df, "id", "n", settings(spark, {"a": 8})).count() == 0 and packing.pack(df, "id", "n", settings(spark, {})).count() == 0


def test_bins_do_not_depend_on_the_shards(spark, monkeypatch):
    df = spark.createDataFrame([(f"i{i}", 1 + i % 5) for i in range(300)], "id string, n int")
    got = []
    for shard in (7, 10**6):
        monkeypatch.setattr(packing, "RANK_SHARD", shard)
        got.append(sorted(map(tuple, packing.pack(df, "id", "n", settings(spark, {"a": 11})).collect())))
    assert got[0] == got[1]


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_equals_highest_quotients(seed):
    rng = random.Random(seed)
    w = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(rng.randint(1, 9))]
    caps = [rng.randint(0, 60) for _ in w] if seed % 2 else None
    seats = rng.randint(0, 150)
    q = [0] * len(w)
    for _ in range(seats):
        best = [(-w[i] / (2 * q[i] + 1), i) for i in range(len(w)) if w[i] > 0 and (caps is None or q[i] < caps[i])]
        if not best:
            break
        q[min(best)[1]] += 1
    assert mixing.sainte_lague(w, seats, caps) == q


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(5, 60), 9) for i, s in enumerate(["a"] * 3000 + ["b"] * 300 + ["c"] * 1500 + ["d"] * 50 + [None] * 5)] + [(9999, "a", 0, 9), (9998, "b", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int, copies int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, t, "doc_id", "source", "n")
    limit = {"a": 1, "b": 4, "c": 2}
    assert all(1 <= r["copies"] <= limit[r["source"]] for r in drawn.collect())
    s = {r["source"]: r for r in shares.collect()}
    for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert s[k]["reached_share"] == pytest.approx(share, abs=0.01)
    assert s["gone"]["tokens"] == 0 and s["d"]["records"] == 0 and s[None]["records"] == 0
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in mixing.mix(df.repartition(7), t, "doc_id", "source", "n")[0].collect()}


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n int")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, t, "doc_id", "source", "n")
    assert drawn.count() == 0 and shares.first()["reached_share"] == 0.0
    assert mixing.mix(df, t.limit(0), "doc_id", "source", "n")[0].count() == 0


def test_any_number_of_settings(spark):
    df = spark.createDataFrame([("x", 3), ("y", 9)], "id string, n int")
    got = packing.pack(df, "id", "n", settings(spark, {f"s{i}": 8 for i in range(1001)}))
    assert got.groupBy("setting").count().where("count = 3").count() == 1001


def test_any_number_of_sources_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 40)
    df = spark.createDataFrame([(i, f"s{i % 1001}", 10) for i in range(9009)], "doc_id long, source string, n int")
    t = spark.createDataFrame([(f"s{i}", 1 / 1001, 1) for i in range(1001)], "source string, target_share double, max_repeats int")
    shares = mixing.mix(df, t, "doc_id", "source", "n", block=10)[1].collect()
    assert len(shares) == 1001 and all(r["tokens"] == 90 for r in shares)
