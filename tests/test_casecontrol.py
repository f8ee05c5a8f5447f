import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gearwatch.operators import casecontrol as C


def days(seed=0):
    rng = np.random.default_rng(seed)
    n = 240
    status = np.where(rng.random(n) < 0.3, "isolated", "clean")
    pdf = pd.DataFrame(
        {
            "period": "overall", "entity": rng.choice(["a", "b", "c"], n), "status": status,
            "failed_part": np.where(status == "isolated", rng.choice(["p", "q"], n), None),
            "z": np.round(rng.normal(0, 2, n) + (status == "isolated"), 1),
        }
    )
    pdf["failed_family"] = np.where(pdf.failed_part.notna(), "f", None)
    return pdf


def test_effects_equal_pairwise_brute_force(spark):
    pdf = days()
    e = C.entity_effects(spark.createDataFrame(pdf), {"m": "z"})
    got = C.summarize(e).toPandas().set_index(["failed_part", "z_threshold"])
    for part in "pq":
        deltas, diffs = [], []
        for entity, g in pdf.groupby("entity"):
            clean = g[g.status == "clean"].z.abs().to_numpy()
            case = g[(g.status == "isolated") & (g.failed_part == part)].z.abs().to_numpy()
            if len(case) and len(clean):
                gap = case[:, None] - clean[None, :]
                deltas.append(((gap > 0).sum() - (gap < 0).sum()) / gap.size)
                diffs.append((case >= 2).mean() - (clean >= 2).mean())
        assert got.loc[(part, 2.0), "cliffs_delta"] == pytest.approx(np.mean(deltas))
        assert got.loc[(part, 2.0), "anomaly_rate_diff_pp"] == pytest.approx(100 * np.mean(diffs))


def test_bootstrap_is_repeatable_and_brackets_the_estimate(spark):
    df = spark.createDataFrame(days(4))
    e = C.entity_effects(df, {"m": "z"})
    key = ["failed_part", "z_threshold"]
    a = C.bootstrap(e, samples=200).toPandas().set_index(key)
    b = C.bootstrap(e.repartition(7, "entity"), samples=200).toPandas().set_index(key)
    pd.testing.assert_frame_equal(a.sort_index(), b.sort_index())
    diff = C.summarize(e).toPandas().set_index(key).anomaly_rate_diff_pp.reindex(a.index)
    assert ((a.ci_low_pp <= diff) & (diff <= a.ci_high_pp)).all()
    out = C.direction(C.with_status(C.summarize(e), C.bootstrap(e, samples=50)))
    assert set(out.toPandas().direction_status) == {"too_few_periods"}


def test_effects_place_ties_nulls_and_cut_batches_in_one_pass(spark, monkeypatch):
    pdf = days(3)
    pdf["period"] = np.where(pdf.index % 3 == 0, "train", "test")
    pdf["w"] = np.where(pdf.index % 5 == 0, np.nan, pdf.z.round())  # ties
    pdf.loc[pdf.index % 7 == 0, "period"] = None
    df = spark.createDataFrame(pdf).withColumn("w", F.nanvl("w", F.lit(None)))
    monkeypatch.setattr(C, "CHUNK", 20)
    plans = []
    keep = C.materialize
    monkeypatch.setattr(C, "materialize", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or keep(x))
    got = C.entity_effects(df, {"m": "z", "n": "w"}).toPandas().set_index(["period", "entity", "failed_part", "sensor", "z_threshold"])
    assert len(plans) == 1 and "Window" not in plans[0] and plans[0].count("Exchange") == 1
    seen = 0
    for (period, entity), g in pdf.groupby(["period", "entity"]):
        for sensor, c in (("m", "z"), ("n", "w")):
            clean = g[g.status == "clean"][c].abs().dropna()
            for part, own in g[g.status == "isolated"].groupby("failed_part"):
                case = own[c].abs().dropna()
                if not len(case) or not len(clean):
                    continue
                gap = case.to_numpy()[:, None] - clean.to_numpy()[None, :]
                for t in C.Z_LIMITS:
                    r, seen = got.loc[(period, entity, part, sensor, t)], seen + 1
                    assert (r.isolated_rows, r.clean_rows, r.isolated_hits, r.clean_hits) == (len(case), len(clean), (case >= t).sum(), (clean >= t).sum())
                    assert r.median_isolated == case.median() and r.median_clean == clean.median()
                    assert r.delta == pytest.approx(((gap > 0).sum() - (gap < 0).sum()) / gap.size)
    assert seen == len(got) > 20


def test_bootstrap_of_many_blocks_draws_the_shares_once_a_group(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 600
    rows = pd.DataFrame(
        {"period": None, "failed_part": "p", "sensor": "m", "z_threshold": 2.0, "entity": np.arange(n), "isolated_rows": 8, "isolated_hits": rng.binomial(8, 0.3, n), "clean_rows": 50, "clean_hits": rng.binomial(50, 0.1, n)}
    )
    df = spark.createDataFrame(rows, "period string, failed_part string, sensor string, z_threshold double, entity long, isolated_rows long, isolated_hits long, clean_rows long, clean_hits long")
    whole = C.bootstrap(df, samples=2000).toPandas()
    monkeypatch.setattr(C, "BLOCK", 50)
    parts = C.bootstrap(df, samples=2000).toPandas()
    again = C.bootstrap(df.repartition(5), samples=2000).toPandas()
    pd.testing.assert_frame_equal(parts, again)
    diff = rows.isolated_hits / 8 - rows.clean_hits / 50
    p, q = rows.isolated_hits / 8, rows.clean_hits / 50
    within = (p * (1 - p) / 8 + q * (1 - q) / 50).mean()  # counts twice: picks of one entity in a redraw share its days
    spread = 100 * np.sqrt((diff.var(ddof=0) + (2 - 1 / n) * within) / n)
    for found in (whole, parts):
        assert found.ci_low_pp[0] == pytest.approx(100 * diff.mean() - 1.96 * spread, abs=spread / 4)
        assert found.ci_high_pp[0] == pytest.approx(100 * diff.mean() + 1.96 * spread, abs=spread / 4)
    shares = C._shares(["k"], 100, 42)((pa.scalar("a"),), pa.table({"k": ["a"] * 3, "block": [2, 0, 1], "size": [10, 20, 30]}))
    assert np.array(shares.column("shares").to_pylist()).sum(axis=0).tolist() == [60] * 100


def test_resampled_days_are_binomial_counts():
    rows, hits = np.array([10, 10, 300, 4, 5]), np.array([3, 3, 12, 4, 0])
    drawn = C._hits(np.random.default_rng(0), rows, hits, 50_000) * rows[:, None]
    assert drawn.mean(axis=1) == pytest.approx(hits, abs=0.1)
    assert drawn.var(axis=1) == pytest.approx(hits * (1 - hits / rows), rel=0.05, abs=1e-9)
    assert (drawn[0] != drawn[1]).any() and not drawn[4].any()
