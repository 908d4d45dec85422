"""The command line: python -m tidelark VERB --trades ... --market ... --labels ... --out FOLDER.

Tables are parquet, csv or json, by the ending of their names; results are written to the folder.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions.series import series
from tidelark.operators import combine as cmb
from tidelark.operators import evaluate as ev
from tidelark.operators import explore as ex
from tidelark.operators import features as ft
from tidelark.operators import ladder as ld
from tidelark.operators import models as md
from tidelark.operators import page as pg
from tidelark.operators import report as rp
from tidelark.operators import states as st
from tidelark.sources import synthetic as syn
from tidelark.sources import tables as tb
from tidelark.sources.config import read_config

VERBS: dict[str, Callable] = {}


def verb(f: Callable) -> Callable:
    VERBS[f.__name__] = f
    return f


class Job:
    """The tables and the folder of one call; a table that a verb needs and that is not given is refused."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args, self.config = spark, args, read_config(args.config)

    def table(self, name: str) -> DataFrame:
        path = getattr(self.args, name)
        if not path:
            raise SystemExit(f"--{name} is needed")
        return tb.read(self.spark, path)

    @property
    def trades(self) -> DataFrame:
        return tb.coerce(self.table("trades"))

    @property
    def market(self) -> DataFrame:
        return self.table("market").withColumn("date", F.to_date("date"))

    @property
    def labels(self) -> DataFrame:
        return self.table("labels").select("pair", F.to_date("date").alias("date"), "regime")

    def write(self, **results: DataFrame) -> None:
        rp.dump({n: (df, n) for n, df in results.items()}, self.args.out, self.args.kind)


@verb
def check(job: Job) -> None:
    """Integrity checks of the trade days; fails where one fails."""
    report = ev.check_trade_days(job.trades).persist()
    print(rp.markdown(report))
    job.write(checks=report, coverage=ev.trade_coverage(job.trades), month_gaps=ev.month_gaps(job.trades))
    ev.assert_clean(report)


@verb
def ladder(job: Job) -> None:
    """The ladder, its increments and its gate."""
    cum = ld.attach_entry_labels(ld.cumulative(job.trades, job.config["horizons"]), job.labels).persist()
    lad = ld.ladder(cum, job.labels, ld.boot_se(cum, job.labels, job.config["n_boot"]) if job.config["ci"] == "boot" else None).persist()
    gate = ev.gate_separation(lad, **job.config["gates"])
    job.write(ladder=ld.shrink(lad), increments=ld.increments(lad), thin_cells=ev.thin_cells(lad), gate2=gate)
    pg.write_gates({"gate2": gate}, f"{job.args.out}/gates.json")


@verb
def labels(job: Job) -> None:
    """Labels by the labeller's search on five-day earn (or realised vol), with the specs to keep."""
    t = _scored(job)
    own = job.config["labeller"]
    spec = md.specs(md.finder(t, own["budget"], own["least_episodes"]), str(own["states"])).persist()
    lab = md.apply_spec(t, spec).persist()
    job.write(labels=lab, specs=spec, durations=st.duration_check(lab.select("pair", "date", "regime")))


@verb
def relabel(job: Job) -> None:
    """Labels of new days by specs that were kept, without a fit."""
    job.write(labels=md.apply_spec(_composite(job), job.table("specs")))


def _composite(job: Job) -> DataFrame:
    names = job.config["labeller"]["features"]
    return ft.composite(ft.build(job.market, names), {n: 1.0 for n in names}).select("pair", "date", F.col("composite").alias("score"))


def _scored(job: Job) -> DataFrame:
    ahead = job.market.select("pair", "date", F.lead("atm_1m", 5).over(series()).alias("level_target"), F.lead("rv_1m", 21).over(series()).alias("target"))
    t = _composite(job).join(ahead, ["pair", "date"])
    if job.args.trades:
        earn = ld.cumulative(job.trades, (5,), expiry=False).groupBy("pair", F.col("entry_date").alias("date")).agg(F.avg("cum_pnl").alias("target"))
        t = t.drop("target").join(earn, ["pair", "date"], "left")
    return t


@verb
def sweep(job: Job) -> None:
    """Variants of the labeller, judged on both windows."""
    t = _scored(job).persist()
    variants = {n: kw for n, kw in md.VARIANTS.items() if "score" not in kw}
    job.write(sweep=md.sweep(t, ld.cumulative(job.trades, job.config["horizons"], expiry=False).persist(), variants))


@verb
def walk_forward(job: Job) -> None:
    """State means against the overall mean, out of sample, and the gate on them."""
    wf = ev.walk_forward(ld.attach_entry_labels(ld.cumulative(job.trades, job.config["horizons"]), job.labels)).persist()
    job.write(walk_forward=wf, gate3=ev.gate_out_of_sample(wf))


@verb
def shock(job: Job) -> None:
    """Shock score and forecast of realised vol."""
    job.write(shock=md.shock_score(job.market), forecast=md.har_forecast(job.market), surprises=st.surprises(job.market))


@verb
def transitions(job: Job) -> None:
    """The transition matrix, holding times, and the fan of each state."""
    own = job.config["transitions"]
    mat = st.transition_matrix(job.labels, own["prior_strength"]).persist()
    fans = st.fans(mat, own["horizon"])
    job.write(matrix=mat, durations=st.duration_check(job.labels), fans=fans, expected_days=st.expected_days(fans))


@verb
def leading(job: Job) -> None:
    """The screen of the leading features against five-day earn, and its gate."""
    base = job.labels.join(_composite(job), ["pair", "date"]).join(ft.build_leading(job.market), ["pair", "date"])
    names = [r[0] for r in job.trades.select("archetype").distinct().orderBy("archetype").collect()]
    t = base.join(md.outcomes(job.trades, job.market, names), ["pair", "date"]).withColumn("y", F.col(names[0])).persist()
    job.write(screen=md.leading_screen(t, list(ft.LEADING), diagnosis="realised_minus_implied"))


@verb
def statistics(job: Job) -> None:
    """Daily statistics to condition on, with their definitions."""
    ex.load_adapter()
    parts = {"leading candidates": ft.build_leading(job.market), "characteristics": st.characteristics(job.market)}
    job.write(statistics=ex.statistics(job.market, parts), definitions=ex.definitions(job.market, parts))


@verb
def tags(job: Job) -> None:
    """Tags of the configuration, and labels split by each."""
    found = st.build_tags(job.market, job.config["tags"]).persist()
    split = {f"labels_{c}": st.tag_split(job.labels, found.select("pair", "date", c), c) for c in found.columns[2:]} if job.args.labels else {}
    job.write(tags=found, **split)


@verb
def combine(job: Job) -> None:
    """The standard combinations whose legs are all there, in units of vega where it is given."""
    td = job.trades
    td = cmb.to_vega_units(td) if "vega" in td.columns else td
    have = {r[0] for r in td.select("archetype").distinct().collect()}
    job.write(**{n: cmb.combine(td, w, n) for n, w in cmb.COMBINATIONS.items() if set(w) <= have})


@verb
def pack(job: Job) -> None:
    """A packet of the data's tables for review."""
    td, m = job.trades.persist(), job.market
    parts = {
        "Checks": ev.check_trade_days(td), "Coverage": ev.trade_coverage(td), "Months without entries": ev.month_gaps(td), "Daily P&L": ev.pnl_summary(td),
        "P&L from entry": ev.pooled_cumulative(ld.cumulative(td, (1, 5, 10))), "Largest days": ev.largest_market_days(td), "Components": ev.component_variance(td), "Market": ev.market_summary(m),
    }
    Path(job.args.out).mkdir(parents=True, exist_ok=True)
    Path(job.args.out, "packet.md").write_text(rp.packet("Data", parts, job.config, job.args.most_characters))


@verb
def view(job: Job) -> None:
    """A page with the market and the labels of each pair."""
    m, lab = job.market, job.labels
    pairs = [r[0] for r in m.select("pair").distinct().orderBy("pair").collect()]
    payload = rp.payload({p: {"market": m.where(F.col("pair") == p), "labels": lab.where(F.col("pair") == p)} for p in pairs})
    Path(job.args.out).mkdir(parents=True, exist_ok=True)
    Path(job.args.out, "page.html").write_text(pg.page(payload, "Market and labels"))


@verb
def validate(job: Job) -> None:
    """How often the ladder's intervals hold the truth of synthetic worlds."""
    found = syn.interval_coverage(job.spark, job.args.worlds, job.args.days).persist()
    print(rp.markdown(found.orderBy("world")))
    job.write(coverage=found)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("tidelark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, epilog="\n".join(f"{n:14} {f.__doc__.splitlines()[0]}" for n, f in VERBS.items()))
    p.add_argument("verb", choices=list(VERBS))
    for name in ("trades", "market", "labels", "specs", "config"):
        p.add_argument(f"--{name}")
    p.add_argument("--out", required=True)
    p.add_argument("--kind", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--most-characters", type=int)
    p.add_argument("--worlds", type=int, default=8)
    p.add_argument("--days", type=int, default=2520)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"tidelark {args.verb}").getOrCreate()
    VERBS[args.verb](Job(spark, args))


if __name__ == "__main__":
    main()
