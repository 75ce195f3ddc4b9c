import numpy as np
import pytest

from millrace.llm import percentiles as P

VALUES = [3.0, -1.5, 0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), 2.0, 2.0, None, float("nan")]


def brute(vals, permille):
    v = sorted(x + 0.0 for x in vals if x is not None and x == x)
    return v[max(1, (len(v) * permille + 999) // 1000) - 1]


def frame(spark):
    rng = np.random.default_rng(5)
    rows = [("a", None, x, "d1", 0) for x in VALUES] + [("a", "s", float(x), f"d{i % 3}", i) for i, x in enumerate(rng.lognormal(0, 20, 400) * rng.choice([-1, 1], 400))] + [("b", "s", None, "d1", 1), ("c", "s", 7.0, "d2", 2)]
    # m, key, prefix and digit are also names that the operator uses
    return spark.createDataFrame(rows, "family string, arm string, v double, day string, rank int").withColumnRenamed("day", "digit")


@pytest.mark.parametrize("by", [None, "digit"])
def test_exact_against_sorting(spark, by):
    df = frame(spark)
    got = {(r["family"], r["arm"], r["permille"]): (r["value"], r["n"]) for r in P.radix_percentiles(df, ["family", "arm"], ["v"], by=by).collect()}
    data = {}
    for r in df.collect():
        data.setdefault((r["family"], r["arm"]), []).append(r["v"])
    for (f, a), vals in data.items():
        n = sum(x is not None and x == x for x in vals)
        for p in P.PERMILLES:
            if n:
                assert got[f, a, p] == (brute(vals, p), n)
            else:
                assert (f, a, p) not in got


def test_daily_summaries_within_the_stated_error(spark):
    df = frame(spark).where("arm = 's' and v is not null")
    days = P.digit_summary(df, ["digit", "family"], ["v"])
    merged = P.merge_summaries(days, ["family"])
    exact = {(r["family"], r["permille"]): r["value"] for r in P.radix_percentiles(df, ["family"], ["v"]).collect()}
    for r in P.summary_percentiles(merged, ["family"], ["v"]).collect():
        assert abs(r["value"] - exact[r["family"], r["permille"]]) <= r["max_relative_error"] * abs(exact[r["family"], r["permille"]])


def test_empty_and_no_groups(spark):
    df = frame(spark)
    assert P.radix_percentiles(df.limit(0), ["family"], ["v"]).count() == 0
    assert P.radix_percentiles(df.where("family = 'c'"), [], ["v"], [500]).first()["value"] == 7.0
    with pytest.raises(ValueError):
        P.radix_percentiles(df, [], ["v"], bits=20)


def test_infinities_and_zero_in_short_summaries(spark):
    rows = [(k, x) for k, xs in {"up": [float("inf")] * 3, "down": [float("-inf")] * 3, "nought": [0.0, -0.0]}.items() for x in xs]
    df = spark.createDataFrame(rows, "family string, v double")
    for bits in (16, 32, 48):
        got = {(r["family"], r["value"]) for r in P.summary_percentiles(P.digit_summary(df, ["family"], ["v"], bits), ["family"], ["v"], bits=bits).collect()}
        assert got == {("up", float("inf")), ("down", float("-inf")), ("nought", 0.0)}
