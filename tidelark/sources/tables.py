"""Tables: readers, the trade-day and market schemas, sinks, and the market derived from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The columns of a trade-day table and the attribution columns of its component sets.
GROUP = ["pair", "archetype", "tenor_days"]
REQUIRED = ["trade_id", "pair", "archetype", "tenor_days", "entry_date", "date", "age", "pnl"]
LEGS = ["pnl_trade", "pnl_delta_hedge", "pnl_vega_hedge"]
FACTORS = ["pnl_vol", "pnl_spot", "pnl_rr", "pnl_fly", "pnl_theta"]
TENOR = 21
#: Loadings on the day's change of vol, spot, risk reversal and butterfly, and the daily constant.
ARCHETYPES = {"straddle_atm": (1.0, 0.0, 0.0, 0.0, -0.02), "put_25d": (0.5, -2.0, -0.3, 0.2, -0.01), "call_25d": (0.5, 2.0, 0.3, 0.2, -0.01)}


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by the ending of its name: parquet, csv (with header) or json; NaN becomes null."""
    r = spark.read.schema(schema) if schema else spark.read
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    df = r.csv(path, header=True, inferSchema=schema is None) if kind == "csv" else r.json(path) if kind == "json" else r.parquet(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in df.schema.fields if f.dataType == T.DoubleType()})


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write to parquet, csv or json by the ending of the name; parquet may be partitioned."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.csv(path, header=True)
    elif kind == "json":
        w.json(path)
    else:
        (w.partitionBy(*by) if by else w).parquet(path)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in the given order, which must leave no ties; missing values stand first."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def where_group(df: DataFrame, **group: object) -> DataFrame:
    """Rows of one group, by equality on the columns given; an unknown column is refused."""
    if unknown := set(group) - set(df.columns):
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    for c, v in group.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def component_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("pnl_")]


def component_sets(df: DataFrame, extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Attribution columns by the set that they sum over; those of no set are under "other"."""
    have, out = component_columns(df), {}
    for name, cols in ({"legs": LEGS, "factors": FACTORS} | (extra or {})).items():
        if own := [c for c in cols if c in have]:
            out[name] = own
    rest = [c for c in have if not any(c in cols for cols in out.values())]
    return out | ({"other": rest} if rest else {})


def coerce(td: DataFrame) -> DataFrame:
    """Trade days with their types: dates without time, whole ages and tenors, and the days that remain."""
    casts = {"trade_id": "string", "pair": "string", "archetype": "string", "tenor_days": "int", "age": "int", "pnl": "double", "entry_date": "date", "date": "date"}
    td = td.withColumns({c: F.col(c).cast(t) for c, t in casts.items()} | {c: F.col(c).cast("double") for c in component_columns(td)})
    return td.withColumn("remaining", F.col("tenor_days") - F.col("age"))


def labels_frame(df: DataFrame, pair: Column, regime: Column) -> DataFrame:
    return df.select(pair.alias("pair"), "date", regime.alias("regime"))


def six(x: Column) -> Column:
    """x to six digits; the small shift keeps exact halves from hanging on the last bit."""
    return F.round(x + 2.3e-9, 6)


def _mean(value: Column, scale: int) -> Column:
    """Mean by an exact decimal sum, so that it does not depend on the order of rows."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double") / F.count(value)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily market of each pair (line status) from the order lines shipped that day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linenumber")
    price = F.col("l_extendedprice")
    disc, tax = _mean(F.col("l_discount"), 4), _mean(F.col("l_tax"), 4)
    g10 = [six(_mean(F.when(F.col("l_linenumber") == k, price), 2) / 50000).alias(f"g10_{k}") for k in (1, 2, 3)]
    m = lines.groupBy(F.col("l_linestatus").alias("pair"), "date").agg(
        six(_mean(price, 2) / 50000).alias("spot"),
        six(5 + 100 * disc).alias("atm_1m"),
        six(5 + 100 * tax).alias("atm_1y"),
        six(100 * (tax - disc)).alias("rr25_1m"),
        six(_mean(F.col("l_quantity"), 2) / 100).alias("fly25_1m"),
        *g10,
    )
    w = Window.partitionBy("pair").orderBy("date")
    m = m.withColumn("i", F.row_number().over(w)).withColumn("r", F.log(F.col("spot") / F.lag("spot").over(w)))
    vol = lambda n: F.when(F.count("r").over(w.rowsBetween(1 - n, 0)) == n, six(100 * F.sqrt(F.lit(252.0)) * F.stddev_samp("r").over(w.rowsBetween(1 - n, 0))))
    return m.withColumns({"rv_1w": vol(5), "rv_1m": vol(21), "rv_3m": vol(63)}).drop("r")


def trade_days(spark: SparkSession, sf_dir: str, archetypes: list[str] | None = None, tenors: tuple[int, ...] = (TENOR,), m: DataFrame | None = None) -> DataFrame:
    """A trade of each archetype and tenor entered every day of the market, held for its tenor."""
    m = market(spark, sf_dir) if m is None else m
    w = Window.partitionBy("pair").orderBy("date")
    d = lambda c: six(F.col(c) - F.lag(c).over(w))
    days = m.select("pair", "date", "i", d("atm_1m").alias("d_vol"), d("spot").alias("d_spot"), d("rr25_1m").alias("d_rr"), d("fly25_1m").alias("d_fly"))
    held = days.where("i > 1").withColumn("tenor_days", F.explode(F.array(*map(F.lit, tenors))))
    held = held.withColumn("age", F.explode(F.sequence(F.lit(1), F.col("tenor_days")))).withColumn("e", F.col("i") - F.col("age"))
    entry = m.select("pair", F.col("i").alias("e"), F.col("date").alias("entry_date"))
    td = held.join(entry, ["pair", "e"])
    loads = [F.struct(F.lit(a).alias("archetype"), *(F.lit(x).alias(n) for n, x in zip(("vol", "spot", "rr", "fly", "theta"), ARCHETYPES[a], strict=True))) for a in archetypes or ARCHETYPES]
    td = td.withColumn("a", F.explode(F.array(*loads)))
    parts = {f"pnl_{n}": six(F.col(f"a.{n}") * F.col(f"d_{n}")) for n in ("vol", "spot", "rr", "fly")} | {"pnl_theta": F.col("a.theta")}
    td = td.withColumns(parts).withColumn("pnl", six(sum((F.col(c) for c in FACTORS[1:]), F.col(FACTORS[0]))))
    td = td.withColumns({"pnl_trade": six(1.4 * F.col("pnl")), "pnl_delta_hedge": six(-0.3 * F.col("pnl"))})
    return td.select(
        F.concat_ws("-", "pair", "a.archetype", F.date_format("entry_date", "yyyy-MM-dd")).alias("trade_id"), "pair", F.col("a.archetype").alias("archetype"), "tenor_days",
        "entry_date", "date", "age", "pnl", *FACTORS, "pnl_trade", "pnl_delta_hedge", six(F.col("pnl") - F.col("pnl_trade") - F.col("pnl_delta_hedge")).alias("pnl_vega_hedge"),
        six(0.4 * F.sqrt((F.col("tenor_days") - F.col("age") + 1) / F.col("tenor_days").cast("double"))).alias("vega"),
    )


def cut_labels(m: DataFrame) -> DataFrame:
    """Labels by fixed cuts of implied vol: carry, agitated, stressed."""
    return labels_frame(m, F.col("pair"), F.when(F.col("atm_1m") < 9.5, "carry").when(F.col("atm_1m") < 10.5, "agitated").otherwise("stressed"))
