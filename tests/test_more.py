"""Operators of specs, combinations, errors, worlds, pages and the command line, on small cases."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest

from tidelark.functions import kernels as kn


def days(n):
    return [d.date() for d in pd.bdate_range(dt.date(2024, 1, 1), periods=n)]


def plain_error(x, band):
    n = len(x)
    e, most = x - x.mean(), min(band, n - 1)
    v = e @ e + 2 * sum((1 - k / (most + 1)) * (e[k:] @ e[:-k]) for k in range(1, most + 1))
    return np.sqrt(max(v / n, 0) / n)


@pytest.mark.parametrize(("h", "n"), [(1, 40), (20, 40), (63, 300), (252, 300), (63, 30), (5, 2)])
def test_errors_at_any_bandwidth(spark, h, n):
    from tidelark.operators.ladder import newey_west

    x = np.random.default_rng(h).normal(0.3, 1, n).cumsum().round(6)
    rows = [("p", "a", 21, f"t{i:04}", d, h, True, float(v), "s") for i, (d, v) in enumerate(zip(days(n), x, strict=True))]
    cl = spark.createDataFrame(rows, "pair string, archetype string, tenor_days int, trade_id string, entry_date date, h int, to_expiry boolean, cum_pnl double, regime string")
    got = {r["regime"]: r["se"] for r in newey_west(cl).collect()}
    assert got["ALL"] == pytest.approx(plain_error(x, h)) and got["s"] == pytest.approx(got["ALL"])


def test_one_trade_has_no_error(spark):
    from tidelark.operators.ladder import newey_west

    cl = spark.createDataFrame([("p", "a", 21, "t", days(1)[0], 5, False, 1.0, "s")], "pair string, archetype string, tenor_days int, trade_id string, entry_date date, h int, to_expiry boolean, cum_pnl double, regime string")
    assert {r["se"] for r in newey_west(cl).collect()} == {None}


def legs(spark, rows):
    d = days(2)
    full = [(f"{a}-{k}", "p", a, 21, d[0], d[1], 1, v) for k, (a, v) in enumerate(rows)]
    return spark.createDataFrame(full, "trade_id string, pair string, archetype string, tenor_days int, entry_date date, date date, age int, pnl double")


def test_combinations_check_their_legs(spark):
    from tidelark.operators import combine as cmb

    w = cmb.COMBINATIONS["rr_25d"]
    assert [r["pnl"] for r in cmb.combine(legs(spark, [("call_25d", 3.0), ("put_25d", 1.0)]), w, "rr").collect()] == [2.0]
    with pytest.raises(ValueError, match="put_25d"):
        cmb.combine(legs(spark, [("call_25d", 3.0)]), w, "rr")
    with pytest.raises(Exception, match="two rows"):
        cmb.combine(legs(spark, [("call_25d", 3.0), ("put_25d", 1.0), ("put_25d", 1.0)]), w, "rr").collect()


def test_reconciliation_finds_the_weights(spark):
    from tidelark.operators import combine as cmb

    rng = np.random.default_rng(0)
    rows = []
    for d in days(60):
        c, p = rng.normal(size=2)
        rows += [("p", 21, d, 1, a, float(v)) for a, v in (("call_25d", c), ("put_25d", p), ("rr_25d", 0.8 * c - 1.2 * p))]
    td = spark.createDataFrame(rows, "pair string, tenor_days int, entry_date date, age int, archetype string, pnl double")
    got = {r["leg"]: r for r in cmb.reconcile(td, "rr_25d", cmb.COMBINATIONS["rr_25d"]).collect()}
    assert got["call_25d"]["coefficient"] == pytest.approx(0.8) and got["put_25d"]["coefficient"] == pytest.approx(-1.2) and got["put_25d"]["r2"] == pytest.approx(1)
    assert cmb.reconcile(td.where("false"), "rr_25d", cmb.COMBINATIONS["rr_25d"]).count() == 0


def scored(spark, n=800):
    rng = np.random.default_rng(7)
    s = 50 + 45 * np.sin(np.arange(n) / 12) + rng.normal(0, 3, n)
    y = np.where(s > 70, 2.0, np.where(s > 30, 1.0, 0.0)) + rng.normal(0, 0.2, n)
    return s, y, spark.createDataFrame([("p", d, float(a), float(b), float(b)) for d, a, b in zip(days(n), s, y, strict=True)], "pair string, date date, score double, target double, level_target double")


def test_specs_label_again_as_the_search_did(spark):
    from tidelark.operators import models as md

    s, y, t = scored(spark)
    report = md.finder(t).persist()
    assert {r["partition"] for r in report.select("partition").distinct().collect()} == {"3", "6", "6x"}
    for part in ("3", "6", "6x"):
        spec = md.specs(report, part)
        r = spec.first()
        assert r["partition"] == part and not r["fell_back"]
        got = [x["regime"] for x in md.apply_spec(t, spec).orderBy("date").collect()]
        want, told = kn.label_candidate(s, y, y, r["halflife"], r["delta"], None if part == "3" else r["dir_k"], part == "6x")
        assert got == want.tolist() and told["r2"] == pytest.approx(r["r2"])
        again = [x["regime"] for x in md.apply_spec(t.where("date <= date '2026-01-01'"), spec).orderBy("date").collect()]
        assert again == got[: len(again)]  # a kept spec says the same of the same days
    fixed = md.fixed_specs(t, 2.0, (30.0, 70.0), 2.0)
    assert {x["regime"] for x in md.apply_spec(t, fixed).collect()} >= {"carry", "stressed"}


def test_rare_extreme_is_merged_and_stays_feasible():
    s = 50 + 30 * np.sin(np.arange(1500) / 30) + np.random.default_rng(0).normal(0, 1, 1500)
    s[700:720] = 99.0  # one run far above all else
    y = np.where(s > 65, 2.0, np.where(s > 35, 1.0, 0.0))
    states, told = kn.label_candidate(s, y, y, 1.0, 2.0, 0.75, True, least_episodes=40)
    assert told["extreme_merged"] and told["extreme_episodes"] >= 1 and "extreme" not in states and "stressed" in states
    assert kn.label_candidate(s, y, y, 1.0, 2.0, 0.75, True, least_episodes=1)[1]["extreme_episodes"] == told["extreme_episodes"]


def test_chains_and_pooled_fits():
    p0, rank = np.array([[0.9, 0.08, 0.02], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]), np.array([0.0, 1.5, 3.0])
    rng = np.random.default_rng(2)
    seqs = []
    for k in range(2):
        psi = rng.standard_normal(4000)
        seqs.append((kn.tilted_chain(p0, rank, psi, 0.5, seed=k), psi, None))
    assert kn.tilt_fits(seqs, rank, matrices=[p0, p0])["beta"] == pytest.approx(0.5, abs=0.12)
    s, psi, _ = seqs[0]
    based = kn.tilt_fits([(s, rng.standard_normal(4000), psi)], rank, matrices=[p0])
    assert based["gamma"] == pytest.approx(0.5, abs=0.15) and abs(based["beta"]) < 0.15


def test_intervals_cover_the_truth(spark):
    from tidelark.sources import synthetic as syn

    rows = syn.interval_coverage(spark, worlds=4, days=1000).collect()
    assert len(rows) == 4 and 0.5 < np.mean([r["coverage"] for r in rows]) <= 1 and np.mean([r["median_error"] for r in rows]) < 1.6


def test_tags_from_a_configuration(spark):
    from tidelark.operators import states as st

    m = spark.createDataFrame([(p, d, i + 1, 1.0 + 0.02 * i, 8.0, 5.0) for p in "ab" for i, d in enumerate(days(40))], "pair string, date date, i int, spot double, atm_1m double, rv_1m double")
    got = st.build_tags(m, {"pairs": {"a": {"events": ["2024-01-10"], "intervention": {"move": 0.1}}}})
    assert got.columns == ["pair", "date", "intervention", "event_window"]
    assert {r["intervention"] for r in got.where("pair = 'b'").collect()} == {"none"} and got.where("pair = 'a' and event_window = 'pre'").count() == 4
    with pytest.raises(ValueError, match="unknown"):
        st.build_tags(m, {"moon": {}})


def test_statistics_first_column_wins_and_adapters(spark):
    from tidelark.operators import explore as ex

    m = spark.createDataFrame([("p", d, 1.0 + 0.01 * i, 8.0 + i % 3, 9.0, 5.0, 5.0, 5.0, -1.0, 0.3, float(i)) for i, d in enumerate(days(30))], "pair string, date date, spot double, atm_1m double, atm_1y double, rv_1w double, rv_1m double, rv_3m double, rr25_1m double, fly25_1m double, flow double")
    more = m.select("pair", "date", "flow", (m["atm_1m"] * 0).alias("atm_1m"))
    got = ex.statistics(m, {"site": more}, {"flow": "net flow"})
    assert got.columns.count("atm_1m") == 1 and got.agg({"atm_1m": "max"}).first()[0] == 10.0
    told = {r["statistic"]: r["group"] for r in ex.definitions(m, {"site": more}, {"flow": "net flow"}).collect()}
    assert told["flow"] == "market columns" and told["atm_1m_pct252"] == "surface and spot"
    assert not ex.load_adapter("no_such_adapter.statistics")


def test_keep_last_and_groups(spark):
    from tidelark.sources import tables as tb

    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, i int, v string")
    assert sorted(r["v"] for r in tb.keep_last(df, ["k"], ["i"]).collect()) == ["y", "z"]
    assert tb.where_group(df, k="a", i=1).count() == 1
    with pytest.raises(ValueError, match="no column"):
        tb.where_group(df, nothing=1)


def test_configurations(tmp_path):
    from tidelark.sources.config import DEFAULT, read_config

    assert read_config() == DEFAULT
    (tmp_path / "c.json").write_text(json.dumps({"labeller": {"states": "6x"}}))
    got = read_config(str(tmp_path / "c.json"))
    assert got["labeller"]["states"] == "6x" and got["labeller"]["budget"] == DEFAULT["labeller"]["budget"]
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError, match="table"):
        read_config(str(tmp_path / "d.json"))


def test_pages_and_gates(spark, tmp_path):
    from tidelark.operators import page as pg

    lad = spark.createDataFrame([("p", "a", 21, "carry", h, 0.1 * h, 0.0, 1.0, 3) for h in (3, 1)], "pair string, archetype string, tenor_days int, regime string, h int, mean double, ci_lo double, ci_hi double, episodes int")
    assert [r["h"] for r in pg.ladder_points(lad, pair="p", archetype="a").collect()] == [1, 3] and pg.tenor_curve(lad, 3, pair="p").count() == 1
    gates = pg.write_gates({"gate1": spark.createDataFrame([(True,)], "pass boolean")}, f"{tmp_path}/g/gates.json")
    assert gates["all_pass"] and json.loads((tmp_path / "g" / "gates.json").read_text())["gate1"]["pass"]
    assert "</script><b>" not in pg.page(json.dumps({"p": {"t": {"columns": {"x": ["</script><b>"]}, "complete": True}}}), "a & b")


def test_command_line(spark, sf, tmp_path):
    from tidelark.__main__ import main
    from tidelark.sources import tables as tb

    m = tb.market(spark, sf).where("date < date '1997-01-01'")
    tb.write(m, f"{tmp_path}/market.parquet")
    tb.write(tb.trade_days(spark, sf, m=spark.read.parquet(f"{tmp_path}/market.parquet")), f"{tmp_path}/trades.parquet")
    tb.write(tb.cut_labels(m), f"{tmp_path}/labels.parquet")
    given = ["--trades", f"{tmp_path}/trades.parquet", "--market", f"{tmp_path}/market.parquet", "--labels", f"{tmp_path}/labels.parquet"]
    for verb, want in (("check", "checks"), ("ladder", "ladder"), ("transitions", "fans"), ("combine", "rr_25d")):
        main([verb, *given, "--out", f"{tmp_path}/{verb}"])
        assert spark.read.parquet(f"{tmp_path}/{verb}/{want}.parquet").count() > 0
    main(["pack", *given, "--out", f"{tmp_path}/pack"])
    assert "## Coverage" in (tmp_path / "pack" / "packet.md").read_text()
    with pytest.raises(SystemExit):
        main(["check", "--out", f"{tmp_path}/none"])
