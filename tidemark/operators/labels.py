"""Peer-relative labels: windowed log-uplifts, a fallback ladder of peers, robust z-scores."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import LabelConfig
from tidemark.functions.dates import within_after, within_before
from tidemark.functions.stats import median_of, rounded, weighted_mean


def bounds(sales: DataFrame, config: LabelConfig = LabelConfig()) -> tuple[datetime.date, datetime.date]:
    """First and last day on which a moment has a whole window of sales on either side."""
    span = sales.agg(F.min("sold_date").alias("lo"), F.max("sold_date").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("no sales")
    first, last = span["lo"] + datetime.timedelta(config.baseline_days), span["hi"] - datetime.timedelta(config.outcome_days)
    if first > last:
        raise ValueError(f"sales from {span['lo']} to {span['hi']} cover no whole window on either side of a moment")
    return first, last


def moments(sales: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Monthly prediction moments within the bounds: a few hundred rows at most."""
    first, last = bounds(sales, config)
    months = sales.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first), "month"), F.lit(last), F.expr("interval 1 month"))).alias("m"))
    return months.select(F.date_add("m", config.grid_day - 1).alias("prediction_moment")).where(F.col("prediction_moment").between(first, last))


def windows(sales: DataFrame, attention: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Per family and moment: base and outcome medians, counts and the blended log-uplift.

    A sale belongs to the few moments within its reach: these are generated from its date by sequence(),
    so there is no join of all moments with all families, and one shuffle by (family, moment) remains.
    """
    days = max(config.baseline_days, config.outcome_days)
    span = bounds(sales, config)

    def reached(rows: DataFrame, day: str) -> DataFrame:
        first = F.trunc(F.date_sub(day, days), "month")
        starts = F.explode(F.sequence(first, F.date_add(day, days), F.expr("interval 1 month")))
        out = rows.withColumn("prediction_moment", starts).withColumn("prediction_moment", F.date_add("prediction_moment", config.grid_day - 1))
        return out.where(F.col("prediction_moment").between(*span))

    base, out = within_before("sold_date", "prediction_moment", config.baseline_days), within_after("sold_date", "prediction_moment", config.outcome_days)
    s = reached(sales, "sold_date").withColumns({"b": base, "o": out}).where("b or o").groupBy("family_id", "prediction_moment")
    s = s.agg(F.median(F.when(F.col("b"), F.col("price_cents"))).alias("base_cents"), F.median(F.when(F.col("o"), F.col("price_cents"))).alias("out_cents"), F.count_if("b").alias("n_base"), F.count_if("o").alias("n_out"))
    s = s.where((F.col("n_base") >= config.min_sales) & (F.col("n_out") >= config.min_sales))
    base, out = within_before("week_date", "prediction_moment", config.baseline_days), within_after("week_date", "prediction_moment", config.outcome_days)
    a = reached(attention, "week_date").withColumns({"b": base, "o": out}).where("b or o").groupBy("family_id", "prediction_moment")
    a = a.agg(F.sum(F.when(F.col("b"), F.col("search_interest"))).alias("bi"), F.sum(F.when(F.col("o"), F.col("search_interest"))).alias("oi"), F.count_if("b").alias("bw"), F.count_if("o").alias("ow"))
    weeks = (F.col("bw") >= config.min_weeks) & (F.col("ow") >= config.min_weeks) & (F.col("bi") > 0) & (F.col("oi") > 0)
    parts = [
        (config.weight_price, F.when((F.col("base_cents") > 0) & (F.col("out_cents") > 0), F.log(F.col("out_cents") / F.col("base_cents")))),
        (config.weight_velocity, F.log((F.col("n_out") + 1) / (F.col("n_base") + 1))),
        (config.weight_interest, F.when(weeks, F.log((F.col("oi") / F.col("ow")) / (F.col("bi") / F.col("bw"))))),
    ]
    return s.join(a, ["family_id", "prediction_moment"], "left").select("family_id", "prediction_moment", "base_cents", "n_base", "n_out", weighted_mean(parts).alias("u"))


def peers(measured: DataFrame, families: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Every measured family with its peers' uplifts and the rung of the ladder they come from (NULL: none).

    Peers meet within (moment, category); the self-join is on that key only after the floor on sales,
    and each family's three rungs are gathered in one pass. A group holds the families of one category.
    """
    w = measured.join(families.select("family_id", "brand", "category"), "family_id")
    other = w.select("prediction_moment", "category", F.col("family_id").alias("p"), F.col("brand").alias("pb"), F.col("base_cents").alias("pc"), F.col("u").alias("pu"))
    band = F.col("pc").between(F.col("base_cents") * config.band_low, F.col("base_cents") * config.band_high)
    brand = F.col("pb") == F.col("brand")
    pairs = w.join(other, ["prediction_moment", "category"], "left")
    self_ = F.col("p") == F.col("family_id")
    got = pairs.groupBy("family_id", "prediction_moment", "base_cents", "n_base", "n_out", "u").agg(
        *(F.collect_list(F.when(~self_ & cond, F.col("pu"))).alias(name) for name, cond in (("r1", brand & band), ("r2", brand), ("r3", band)))
    )
    pick = lambda f: F.when(F.size("r1") >= config.min_peers, f("r1", "brand")).when(F.size("r2") >= config.min_peers, f("r2", "brand_wide")).when(F.size("r3") >= config.min_peers, f("r3", "category"))
    return got.withColumns({"peer_uplifts": pick(lambda c, _: F.col(c)), "peer_basis": pick(lambda _, b: F.lit(b))}).drop("r1", "r2", "r3")


def labels(sales: DataFrame, attention: DataFrame, families: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """The labelled rows; thresholds apply before rounding."""
    p = peers(windows(sales, attention, config), families, config).where("peer_basis is not null")
    p = p.withColumn("med", median_of(F.col("peer_uplifts")))
    p = p.withColumn("mad", median_of(F.transform("peer_uplifts", lambda x: F.abs(x - F.col("med")))))
    z = (F.col("u") - F.col("med")) / F.greatest(F.col("mad") * 1.4826, F.lit(config.min_spread))
    edge = F.exp("u") - F.exp("med")
    return p.select(
        "family_id", "prediction_moment", (F.col("base_cents") / 100.0).alias("baseline_price_usd"), rounded(F.col("u"), 4).alias("log_uplift"),
        rounded(F.col("med"), 4).alias("peer_median_log_uplift"), rounded(z, 3).alias("peer_z"), rounded(edge, 4).alias("uplift_edge"),
        F.size("peer_uplifts").cast("long").alias("n_peers"), "peer_basis", F.col("n_base").alias("n_baseline_sales"), F.col("n_out").alias("n_outcome_sales"),
        ((z >= config.z_threshold) & (edge >= config.min_edge)).alias("label"),
    )


def threshold_grid(labelled: DataFrame) -> DataFrame:
    """Positives under nine pairs of thresholds on the rounded values: one pass, nine counters."""
    pairs = [(z, e) for z in (1.5, 2.0, 2.5) for e in (0.10, 0.15, 0.25)]
    counts = labelled.agg(*(F.count_if((F.col("peer_z") >= z) & (F.col("uplift_edge") >= e)).alias(f"c{i}") for i, (z, e) in enumerate(pairs)), F.count("*").alias("n_rows"))
    rows = F.array(*(F.struct(F.lit(z).alias("z_threshold"), F.lit(e).alias("min_edge"), F.col(f"c{i}").alias("n_positive")) for i, (z, e) in enumerate(pairs)))
    return counts.select(F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")


def summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("peer_basis").agg(F.count("*").alias("n_rows"), F.count_distinct("family_id").alias("n_families"), F.count_if("label").alias("n_positive"))


def exclusions(sales: DataFrame, attention: DataFrame, families: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Cells of the moments x families grid by what became of them."""
    p = peers(windows(sales, attention, config), families, config)
    n = p.agg(F.count("*").alias("measured"), F.count_if(F.col("peer_basis").isNull()).alias("peerless"))
    grid = moments(sales, config).agg(F.count("*").alias("m")).join(families.agg(F.count("*").alias("f")), F.lit(True))
    return n.join(grid, F.lit(True)).select((F.col("m") * F.col("f") - F.col("measured")).alias("thin"), "peerless", (F.col("measured") - F.col("peerless")).alias("labelled"))


