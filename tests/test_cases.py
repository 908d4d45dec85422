"""Small cases whose answers are known, identities, and the promises of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidelark.functions import kernels as kn

DAY = dt.date(2024, 1, 1)


def days(n, start=DAY):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def series(spark, values, kind="double", name="x"):
    return spark.createDataFrame([("p", d, v) for d, v in zip(days(len(values)), values, strict=True)], f"pair string, date date, {name} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize(
    ("level", "direction", "want"),
    [
        ("low low low mid mid high high", "flat down up up flat flat down", "carry carry rising rising agitated stressed normalising"),
        ("high mid low", "down down down", "normalising normalising settling"),
        ("extreme extreme high", "up down down", "extreme extreme normalising"),
    ],
)
def test_partition_walk(spark, level, direction, want):
    from tidelark.functions.scans import state_scan

    rows = [("p", d, a, b) for d, a, b in zip(days(9), level.split(), direction.split(), strict=False)]
    assert column(state_scan(spark.createDataFrame(rows, "pair string, date date, level string, direction string")), "regime") == want.split()
    at = {"low": 0, "mid": 1, "high": 2, "extreme": 3}
    to = {"down": -1, "flat": 0, "up": 1}
    assert kn.walk(np.array([at[x] for x in level.split()]), np.array([to[x] for x in direction.split()])).tolist() == want.split()


def test_rolling_percentile_and_nulls(spark):
    from tidelark.functions.series import rolling_percentile

    df = series(spark, [1.0, 2.0, 3.0, None, 2.5, None, 4.0]).withColumn("r", rolling_percentile("x", 4, 2))
    got = column(df, "r")
    assert got[0] is None and got[3] is None and got[5] is None
    assert [got[1], got[2], got[4], got[6]] == pytest.approx([100, 100, 100 / 3, 100 / 3])


def test_ewma_with_gaps(spark):
    from tidelark.functions.scans import ewma_scan

    want = pd.Series([np.nan, 1, np.nan, 2, 3]).ewm(halflife=1, adjust=False).mean()
    got = column(ewma_scan(series(spark, [None, 1.0, None, 2.0, 3.0]), "x", 1.0), "ewma")
    assert got[0] is None and got[1:] == pytest.approx(want[1:].tolist())
    assert kn.ewma(np.array([np.nan, 1, np.nan, 2, 3]), 1.0)[1:] == pytest.approx(want[1:].tolist())


def test_scans_agree_with_kernels(spark):
    from tidelark.functions.scans import direction_scan, level_scan

    x = np.random.default_rng(2).normal(50, 20, 200).round(3)
    lv = column(level_scan(series(spark, x.tolist()), "x", [30.0, 70.0, 90.0], 3.0), "level")
    assert [["low", "mid", "high", "extreme"][k] for k in kn.levels(x, (30.0, 70.0, 90.0), 3.0)] == lv
    d = column(direction_scan(series(spark, x.tolist()), "x", 40.0, 60.0, 2.0), "direction")
    assert [["down", "flat", "up"][k + 1] for k in kn.directions(x, 40.0, 60.0, 2.0)] == d


def test_merge_rare(spark):
    from tidelark.operators.states import merge_rare, runs

    lab = series(spark, ["carry"] * 10 + ["extreme"] * 3 + ["stressed"] * 5 + ["extreme"] * 2 + ["carry"] * 5, "string", "regime")
    assert runs(lab).where("regime = 'extreme'").count() == 2
    assert merge_rare(lab, "extreme", "stressed", 5).where("regime = 'stressed'").count() == 10
    assert merge_rare(lab, "extreme", "stressed", 2).where("regime = 'extreme'").count() == 5


def test_step_fit():
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 100, 2000)
    y = np.where(s < 30, 0, np.where(s < 70, 5, 10)) + rng.standard_normal(2000)
    a, b = kn.step_bounds(s, y)
    assert 25 < a < 35 and 65 < b < 75


def test_event_window_and_ramp(spark):
    from tidelark.operators.states import event_proximity, event_window_tag

    m = series(spark, [1.0] * 20)
    ev = spark.createDataFrame([(dt.date(2024, 1, 10),), (dt.date(2024, 1, 13),)], "date date")
    got = dict(zip(days(20), column(event_window_tag(m, ev, 2, 1), "event"), strict=True))
    assert [got[dt.date(2024, 1, d)] for d in (8, 9, 10, 11)] == ["pre", "pre", "pre", "pre"]
    assert [got[dt.date(2024, 1, d)] for d in (12, 15, 16, 17)] == ["pre", "pre", "post", "none"]
    ramp = dict(zip(days(20), column(event_proximity(m, spark.createDataFrame([(dt.date(2024, 1, 22),)], "date date"), 5), "event_proximity"), strict=True))
    assert [ramp[dt.date(2024, 1, d)] for d in (22, 19, 23, 15)] == pytest.approx([1.0, 0.8, 0.0, 0.0])


def test_runs_and_escalations(spark):
    from tidelark.operators.states import escalations, runs

    lab = series(spark, "carry carry rising stressed stressed agitated stressed carry".split(), "string", "regime")
    assert (runs(lab).count(), runs(lab).agg({"days": "sum"}).first()[0]) == (6, 8)
    assert [(r["date"], r["from_state"]) for r in escalations(lab).orderBy("date").collect()] == [(days(8)[3], "rising"), (days(8)[6], "agitated")]


def test_business_days(spark):
    from pyspark.sql import functions as F

    from tidelark.functions.series import business_days

    pairs = [(dt.date(2024, 1, d), dt.date(2024, 1, e)) for d in range(1, 20) for e in range(d, 25)]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", (business_days("b") - business_days("a")).alias("n")).withColumn("n", F.col("n").cast("int")).collect()
    assert all(r["n"] == np.busday_count(r["a"], r["b"]) for r in got)


def test_ladder_identities(spark, sf):
    from pyspark.sql import functions as F

    from tidelark.operators import ladder as ld
    from tidelark.plans.catalogue import World

    w = World(spark, sf)
    lad = w.ladder.cache()
    own = lad.where("regime <> 'ALL'").groupBy("pair", "archetype", "h").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    both = own.join(lad.where("regime = 'ALL'").select("pair", "archetype", "h", "mean", F.col("n").alias("all_n")), ["pair", "archetype", "h"]).collect()
    assert both and all(r["n"] == r["all_n"] and r["m"] == pytest.approx(r["mean"], abs=1e-9) for r in both)
    split = ld.persistence_split(w.td, w.labels).na.fill(0.0).collect()
    assert all((1 - r["q_broke"]) * r["ev_stayed"] + r["q_broke"] * r["ev_broke"] == pytest.approx(r["ev"], abs=1e-9) for r in split)
    inc = ld.increments(lad).groupBy("pair", "archetype", "regime").agg(F.sum(F.col("earn_per_day") * (F.col("h_to") - F.col("h_from") + 1)).alias("s"))
    last = lad.where("to_expiry").select("pair", "archetype", "regime", "mean")
    assert all(r["s"] == pytest.approx(r["mean"], abs=1e-9) for r in inc.join(last, ["pair", "archetype", "regime"]).collect())
    lad.unpersist()


def test_integrity_faults(spark, sf):
    from pyspark.sql import functions as F

    from tidelark.operators import evaluate as ev
    from tidelark.plans.catalogue import World

    td = World(spark, sf).td.where("archetype = 'put_25d' and entry_date < '1995-06-01'")
    report = lambda t: {r["check"]: r["passed"] for r in ev.check_trade_days(t).collect()}
    ev.assert_clean(ev.check_trade_days(td))
    one = td.limit(1)
    assert not report(td.unionByName(one))["no_duplicate_trade_date"]
    assert not report(td.where("not (age = 3 and pair = 'F')"))["ages_consecutive_from_1"]
    assert not report(td.withColumn("pnl_vol", F.col("pnl_vol") + F.when(F.col("age") == 2, 1).otherwise(0)))["components_sum_to_pnl_factors"]
    assert not report(td.withColumn("date", F.when(F.col("age") == 1, F.col("entry_date")).otherwise(F.col("date"))))["date_after_entry"]
    assert report(td.drop("pnl")) == {"required_columns": False}
    with pytest.raises(AssertionError):
        ev.assert_clean(ev.check_trade_days(td.unionByName(one)))


def test_every_feature_is_point_in_time(spark, sf):
    from pyspark.sql import functions as F

    from tidelark.functions.series import series
    from tidelark.operators import features as ft
    from tidelark.plans.catalogue import World

    m = World(spark, sf).market.where("pair = 'F'").cache()
    for registry in (ft.FEATURES, ft.LEADING):
        for f in registry.values():
            assert ft.truncation_gaps(f, m, "1997-06-30").isEmpty()
    leak = lambda t: t.withColumn("leak", F.lead("spot", 5).over(series()))
    assert not ft.truncation_gaps(leak, m, "1997-06-30").isEmpty()
    m.unpersist()


def test_filters():
    from tidelark.operators.explore import filter_column, filter_text

    with pytest.raises(ValueError, match="unknown"):
        filter_column({"stat": "x", "op": "~", "value": 1})
    yaml = pytest.importorskip("yaml")
    spec = {"stat": "x", "op": "between", "value": [1, 2], "and": [{"stat": "regime", "op": "in", "value": ["carry"]}]}
    assert yaml.safe_load("filters:\n" + filter_text("f", spec)) == {"filters": {"f": spec}}


def test_tilt_and_fit():
    p0, rank = kn.count_matrix(np.array([0, 0, 1, 2, 1, 0, 0, 1, 2, 2, 1, 0]), 3), np.array([0.0, 1.5, 3.0])
    t = kn.tilted(p0, rank, np.array([0.0, np.nan, 2.0]))
    assert np.allclose(t[0], p0) and np.allclose(t[1], p0) and np.allclose(t.sum(axis=2), 1)
    rng, s = np.random.default_rng(4), [0]
    psi = rng.standard_normal(4000)
    for v in psi[:-1]:
        s.append(int(rng.choice(3, p=kn.tilted(p0, rank, np.array([0.6 * v]))[0, s[-1]])))
    assert kn.tilt_fit(p0, rank, np.array(s), psi) == pytest.approx(0.6, abs=0.12)
    assert kn.tilt_gain(np.array(s), psi, rank)["gain"] > 0 > kn.tilt_gain(np.array(s), rng.permutation(psi), rank)["gain"] - 0.002


def test_shocks_are_seen():
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.standard_normal(400), 2.5 * rng.standard_normal(60)])
    h = kn.cusum_threshold(0.3, 1000)
    assert 400 <= np.flatnonzero(kn.cusum(z**2, 0.3, h) > h)[0] < 430
    young, run = kn.change_points(np.concatenate([rng.standard_normal(200), 6 + rng.standard_normal(40)]))
    assert young[:200][20:].max() < 0.9 and young[201:206].max() > 0.9 and run[-1] < 45


def test_sub_states_found_and_not_invented():
    rng = np.random.default_rng(0)
    ep = np.repeat(np.arange(30), 10)
    two = np.where((np.arange(300) // 10 % 2)[:, None] == 0, 0.0, 4.0) + rng.standard_normal((300, 3))
    best = lambda r: max(x["k"] for x in r if x["accepted"])
    assert best(kn.sub_states(two, ep)) == 2
    assert kn.sub_states(two[:50], ep[:50]) == []


def test_block_bootstrap_covers():
    rng, hit = np.random.default_rng(3), 0
    for i in range(200):
        e = rng.standard_normal(304)
        x = np.convolve(e, np.ones(5) / 5, "valid")
        lo, hi = kn.block_bootstrap(x, 10, 300, 0.1, 0, ("c", i))
        hit += lo <= 0 <= hi
    assert hit / 200 > 0.78


def test_readers_and_sinks(spark, tmp_path):
    from tidelark.sources import tables as tb

    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "i int, x double")
    for kind in ("parquet", "csv", "json"):
        tb.write(df, f"{tmp_path}/t.{kind}")
        assert sorted((r["i"], r["x"]) for r in tb.read(spark, f"{tmp_path}/t.{kind}", df.schema).na.fill(-1.0).collect()) == [(1, -1.0), (2, 2.0)]


def test_stream_scan(spark, tmp_path):
    from tidelark.streaming.scans import stream_levels

    rows = [("p", d, float(x)) for d, x in zip(days(12), [1, 5, 9, 8, 2, 1, 6, 9, 9, 1, 1, 5], strict=True)]
    spark.createDataFrame(rows[:6], "pair string, date date, x double").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(rows[6:], "pair string, date date, x double").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    src = spark.readStream.schema("pair string, date date, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_levels(src, "x", (3.0, 7.0), 0.5).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["date"]: r["level"] for r in spark.table("levels").collect()}
    want = kn.levels(np.array([r[2] for r in rows]), (3.0, 7.0), 0.5)
    assert [got[d] for d in days(12)] == want.tolist()


def test_reports(spark, tmp_path):
    import json

    from tidelark.operators import report

    lad = spark.createDataFrame([("p", "a", 21, "carry", h, 5, 2.0, 3, 0.1 * h, None, None, 0.5, -1.0, -2.0) for h in (1, 3)], "pair string, archetype string, tenor_days int, regime string, h int, n int, n_eff double, episodes int, mean double, ci_lo double, ci_hi double, p_profit double, q05 double, es05 double")
    inc = spark.createDataFrame([("p", "a", "carry", "d1-1", 1, 0.1), ("p", "a", "carry", "d2-3", 2, -0.2)], "pair string, archetype string, regime string, bucket string, h_from int, earn_per_day double")
    text = report.card(lad, inc, "p", "a", "carry")
    assert "Thin evidence: 3 episodes" in text and "d2-3 at -0.2" in text and text.count("\n| ") >= 3
    assert "(first 1 rows)" in report.markdown(lad, 1)
    cut = report.packet("t", {"ladder": lad, "inc": inc}, most_characters=300)
    assert len(cut) <= 300 and "Left out for the packet's size: ladder, inc" in cut and "Left out" not in report.packet("t", {"ladder": lad})
    assert report.dump({"ladder": (lad, "the ladder")}, str(tmp_path)).count() == 1 and (tmp_path / "ladder.csv").exists()
    page = json.loads(report.payload({"p": {"ladder": lad}}))
    assert page["p"]["ladder"]["columns"]["ci_lo"] == [None, None] and page["p"]["ladder"]["complete"]
    with pytest.raises(ValueError, match="pair"):
        report.payload({})


def test_leading_screen_asks_the_holdout(spark):
    from tidelark.operators import models as md

    rng = np.random.default_rng(5)
    n, rows = 1500, []
    for pair, late in (("p", -1.0), ("q", 1.0)):
        x = np.zeros(n)
        for i in range(1, n):
            x[i] = 0.9 * x[i - 1] + rng.normal()
        for i, d in enumerate(days(n)):
            y = (x[i] if i < 0.8 * n else late * x[i]) + rng.normal()
            rows.append((pair, d, "stressed" if x[max(0, i - 4)] + rng.normal() > 0.5 else "carry", float(rng.normal()), float(y), float(x[i]), float(rng.normal())))
    t = spark.createDataFrame(rows, "pair string, date date, regime string, score double, y double, lead double, noise double")
    got = {(r["pair"], r["feature"]): r for r in md.leading_screen(t, ["lead", "noise"], permutations=19).collect()}
    assert got["p", "lead"]["for_holdout"] and not got["p", "lead"]["retain"] and got["p", "lead"]["fail_reason"] == "holdout_delta_r2"
    assert got["q", "lead"]["retain"] and got["q", "lead"]["fail_reason"] == ""
    for pair in "pq":
        assert not got[pair, "noise"]["for_holdout"] and not got[pair, "noise"]["retain"] and got[pair, "noise"]["delta_r2_holdout"] is None


def test_payload_is_whole_and_by_date(spark):
    import json

    from tidelark.operators import report

    t = spark.range(2499, numPartitions=3).selectExpr("date_sub(date '2020-01-01', cast(id as int)) as date", "id as x")
    got = json.loads(report.payload({"p": {"daily": t}}))["p"]["daily"]
    assert got["columns"]["x"] == list(range(2498, -1, -1)) and got["complete"]
    assert got["columns"]["date"] == sorted(got["columns"]["date"])


def test_ladder_boot_draws_as_often_as_the_operator(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from tidelark.plans import catalogue

    seen = []
    want = inspect.signature(catalogue.ld.boot_se).parameters["n_boot"].default
    monkeypatch.setattr(catalogue.ld, "boot_se", lambda cum_lab, labels, n_boot=want: seen.append(n_boot))
    monkeypatch.setattr(catalogue.ld, "ladder", lambda *a: None)
    catalogue.CATALOGUE["ladder_boot"][0](SimpleNamespace(cum_lab=None, labels=None))
    assert seen == [want] == [1000]
