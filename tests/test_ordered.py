import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gearwatch.operators import ordered as O
from gearwatch.operators.ranking import page, with_neighbours


def skewed(rows=600, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(rows) < 0.6, "hot", rng.choice(list("abcdef"), rows))
    v = np.where(rng.random(rows) < 0.34, 7.0, np.round(rng.normal(0, 5, rows), 1))
    return pd.DataFrame({"g": g, "v": v, "id": np.arange(rows)})


def test_running_totals_match_pandas_on_skewed_groups(spark):
    pdf = skewed()
    out = O.running_totals(spark.createDataFrame(pdf), ["g"], [("v", False), ("id", True)], {"w": "id"}, ranges=9).toPandas()
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["w_before"] = want.groupby("g").id.cumsum() - want.id
    merged = out.merge(want[["id", "w_before"]], on="id")
    assert len(merged) == len(pdf)
    assert (merged.w_before_x == merged.w_before_y).all()
    assert (out.groupby("g").w_total.first() == pdf.groupby("g").id.sum()).all()


def test_row_numbers_with_text_descending(spark):
    pdf = pd.DataFrame({"t": ["b", "a", "c", "b", "a"], "id": [1, 2, 3, 4, 5]})
    out = O.row_numbers(spark.createDataFrame(pdf), [], [("t", False), ("id", True)], "r", ).toPandas().sort_values("r")
    assert out.id.tolist() == [3, 1, 4, 2, 5]
    assert set(out.r_of) == {5}


def test_quantiles_match_numpy(spark):
    pdf = skewed(401, 3)
    out = O.quantiles(spark.createDataFrame(pdf), ["g"], "v", {"q1": 0.25, "median": 0.5, "p9": 0.9}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(out.loc[g, ["q1", "median", "p9"]].astype(float), np.quantile(part.v, [0.25, 0.5, 0.9]))
        assert out.loc[g, "n"] == len(part)


def test_page_is_stable_clamped_and_puts_nulls_last(spark):
    pdf = pd.DataFrame({"id": range(10), "x": [3.0, None, 1.0, 3.0, None, 2.0, 3.0, 1.0, None, 0.0]})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    rows, info = page(df, "x", True, 0, 4, ["id"])
    assert [r.id for r in rows.orderBy("position").collect()] == [0, 3, 6, 5]
    rows, info = page(df, "x", False, 99, 4, ["id"])
    assert info == {"total_rows": 10, "page_count": 3, "page": 2}
    assert [r.id for r in rows.orderBy("position").collect()] == [4, 8]


def test_neighbours_are_cyclic(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    out = {r.k: (r.previous, r.next) for r in with_neighbours(df, "k").collect()}
    assert out == {"a": ("c", "b"), "b": ("a", "c"), "c": ("b", "a")}


def test_quantiles_of_rows_match_numpy_and_order_only_a_few_bins(spark, monkeypatch):
    pdf = skewed(3000, 5)
    pdf.loc[pdf.g == "a", "v"] = 4.0  # no span
    pdf.loc[pdf.index[7], "v"] = 1e9  # all others in one bin
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "b", F.col("g")))
    seen, totals = [], O.running_totals
    monkeypatch.setattr(O, "running_totals", lambda d, *a, **k: (seen.append(d.count()), totals(d, *a, **k))[1])
    out = {r.g: r for r in O.quantiles_of_rows(df, ["g"], "v", {"q1": 0.25, "median": 0.5}).collect()}
    for g, part in pdf.groupby("g"):
        row = out[None if g == "b" else g]
        assert np.allclose([row.q1, row.median], np.quantile(part.v, [0.25, 0.5])) and row.n == len(part)
    assert O.quantiles_of_rows(df.filter("false"), ["g"], "v", {"median": 0.5}).count() == 0
    spread = spark.range(20_000).select((F.xxhash64("id") / 1e18).alias("v"))
    seen.clear()
    O.quantiles_of_rows(spread, [], "v", {"median": 0.5}).collect()
    assert seen[0] < 100  # of 20,000


def test_rows_against_the_one_before_over_many_ranges(spark, monkeypatch):
    from gearwatch.operators.quality import reverse_rows

    monkeypatch.setattr(O, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr("gearwatch.operators.ordered.running_totals", None)  # rows were numbered and joined with themselves
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 900, p=[0.9, 0.1]), "d": rng.integers(0, 9, 900), "i": rng.permutation(900)})
    want = sum(int((g.sort_values("i").d.diff() < 0).sum()) for _, g in pdf.groupby("k"))
    df = spark.createDataFrame(pdf)
    assert reverse_rows(df, ["k"], "d", "i").first()[0] == want
    assert reverse_rows(df.filter("false"), ["k"], "d", "i").first()[0] == 0


def test_ranges_follow_the_order_with_nulls_and_are_set_once(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    ranged = O.with_range(df, [("v", False), ("id", True)], 9)
    assert "Scan" in ranged._jdf.queryExecution().executedPlan().toString().splitlines()[-1]
    ends = ranged.groupBy("_range").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("known")).orderBy("_range").collect()
    known = [r for r in ends if r.known]
    assert len(known) > 3 and all(a.lo > b.hi for a, b in zip(known, known[1:]))
    assert ends[-1].known < 99 and all(r.known for r in ends[: len(known)])  # unknown values come last, as in a window
    out = O.row_numbers(df, [], [("v", False), ("id", True)])
    assert [r.id for r in out.filter("rank <= 2 OR rank = 300").orderBy("rank").collect()] == [299, 298, 297]
