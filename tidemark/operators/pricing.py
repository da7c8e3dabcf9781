"""What a family is worth as of a day, and the replay of buy-hold-sell policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BacktestConfig, PricingConfig
from tidemark.functions.dates import month_of, months_after, within_before
from tidemark.functions.stats import rounded


def condition_factor(grade: str, config: PricingConfig = PricingConfig()) -> Column:
    """Price share of a condition grade against the reference grade; an unknown grade counts in full."""
    return F.coalesce(F.greatest(F.lit(config.floor), 1 - config.grade_step * (config.reference_grade - F.col(grade))), F.lit(1.0))


def worth(asks: DataFrame, sales: DataFrame, config: PricingConfig = PricingConfig(), tier: str | None = None, condition: bool = False) -> DataFrame:
    """(family_id, as_of, n_comps, p25, median, p75) for the asked (family_id, as_of) with enough comparable sales.

    One join on family and month; days are asked once however many trades want them.
    """
    comps = sales if tier is None else sales.where(F.col("colorway_tier") == tier)
    price = F.col("price_cents") / condition_factor("condition_ordinal", config) if condition else F.col("price_cents").cast("double")
    j = asks.select("family_id", "as_of", month_of("as_of")).distinct().join(months_after(comps.withColumn("p", price), "sold_date", config.window_days), ["family_id", "month"]).where(within_before("sold_date", "as_of", config.window_days))
    got = j.groupBy("family_id", "as_of").agg(F.count("*").alias("n_comps"), F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).where(F.col("n_comps") >= config.min_comps)
    return got.select("family_id", "as_of", "n_comps", *(rounded(F.get("q", F.lit(i)) / 100, 4).alias(n) for i, n in enumerate(("p25", "median", "p75"))))


def hold_or_move(score: Column, days: Column, config: PricingConfig = PricingConfig()) -> Column:
    """struct(action, reason): age first, then a missing or faded signal."""
    s = lambda a, why: F.struct(F.lit(a).alias("action"), F.lit(why).alias("reason"))
    return F.when(days >= config.max_hold_days, s("move", "age")).when(score.isNull(), s("move", "no signal")).when(score < config.fade_score, s("move", "faded")).otherwise(s("hold", "demand holds"))


def watchlist(candidates: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(policy, cutoff, family_id): at most k flagged families of each policy at each cutoff, ties to the smaller id."""
    model = candidates.where(F.col("score") >= config.min_score).select(F.lit("model").alias("policy"), "cutoff", "family_id", F.col("score").alias("by"), "label")
    search = candidates.where(F.col("search_slope_60d") > 0).select(F.lit("search").alias("policy"), "cutoff", "family_id", F.col("search_slope_60d").alias("by"), "label")
    w = Window.partitionBy("policy", "cutoff").orderBy(F.desc("by"), "family_id")
    return model.unionByName(search).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.k)


def usable_cutoffs(candidates: DataFrame, sales: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Candidates whose horizon ends before the sales do."""
    last = sales.agg(F.max("sold_date").alias("last_sale"))
    return candidates.join(F.broadcast(last), F.date_add("cutoff", config.pricing.max_hold_days) <= F.col("last_sale"))


def exits(bought: DataFrame, scores: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """First later moment of the grid at which hold-or-move says move, else the horizon.

    The grid is the distinct scored moments, a few hundred rows; a moment without a score is a fade.
    """
    hold = config.pricing.max_hold_days
    grid = F.broadcast(scores.select(F.col("cutoff").alias("moment")).distinct())
    walk = bought.select("policy", "cutoff", "family_id").join(grid, F.col("moment") > F.col("cutoff"))
    known = scores.select("family_id", F.col("cutoff").alias("moment"), F.col("score").alias("later"))
    walk = walk.join(known, ["family_id", "moment"], "left")
    days = F.datediff("moment", "cutoff")
    moves = walk.where(hold_or_move(F.col("later"), days, config.pricing)["action"] == "move").groupBy("policy", "cutoff", "family_id").agg(F.min("moment").alias("sell_on"))
    out = bought.join(moves, ["policy", "cutoff", "family_id"], "left")
    held = F.coalesce(F.datediff("sell_on", "cutoff"), F.lit(hold))
    return out.withColumns({"days_held": held, "sold_on_fade": F.coalesce(F.datediff("sell_on", "cutoff") < hold, F.lit(False)), "sell_on": F.coalesce("sell_on", F.date_add("cutoff", hold))})


def trades(candidates: DataFrame, sales: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One row per trade of every policy; families without comps at the cutoff are not bought."""
    bought = exits(watchlist(usable_cutoffs(candidates, sales, config), config), candidates, config)
    last = sales.agg(F.max("sold_date").alias("last"))
    bought = bought.join(F.broadcast(last), F.lit(True)).withColumn("sell_date", F.least("sell_on", "last"))
    asks = bought.select("family_id", F.col("cutoff").alias("as_of")).unionByName(bought.select("family_id", F.col("sell_date").alias("as_of")))
    price = worth(asks, sales, config.pricing).select("family_id", "as_of", "median")
    buy = price.select("family_id", F.col("as_of").alias("cutoff"), F.col("median").alias("buy"))
    sell = price.select("family_id", F.col("as_of").alias("sell_date"), F.col("median").alias("sell"))
    t = bought.join(buy, ["family_id", "cutoff"]).join(sell, ["family_id", "sell_date"], "left").withColumn("sell", F.coalesce("sell", "buy"))
    margin = F.col("sell") * (1.0 - config.fee_rate) - F.col("buy") - config.hold_cost_per_day * F.col("days_held")
    return t.select(
        "policy", "cutoff", "family_id", rounded(F.col("buy"), 2).alias("buy_price"), rounded(F.col("sell"), 2).alias("sell_price"), "sell_date", "days_held", "sold_on_fade",
        F.col("label").alias("was_positive"), rounded(margin, 2).alias("net_margin"), rounded(margin / F.col("buy"), 4).alias("return_pct"),
    )


def policy_summary(done: DataFrame, policies: DataFrame) -> DataFrame:
    """Aggregates of every policy, zeros for one without trades."""
    mean = lambda c, p: rounded(F.avg(c), p)
    got = done.groupBy("policy").agg(
        F.count("*").alias("n_trades"), rounded(F.sum("net_margin"), 2).alias("total_net_margin"), mean("net_margin", 2).alias("mean_net_margin"), mean("return_pct", 4).alias("mean_return_pct"),
        mean(F.col("was_positive").cast("int"), 4).alias("watchlist_precision"), mean("days_held", 1).alias("mean_days_to_sell"), mean(F.col("sell_price") / F.col("buy_price"), 4).alias("mean_price_realization"), mean(F.col("sold_on_fade").cast("int"), 4).alias("sold_on_fade_rate"),
    )
    return policies.join(got, "policy", "left").select("policy", *(F.coalesce(c, F.lit(0)).alias(c) for c in got.columns if c != "policy"))


def per_cutoff(done: DataFrame, cutoffs: DataFrame, policies: DataFrame) -> DataFrame:
    """The same by policy and cutoff on the dense grid of both."""
    got = done.groupBy("policy", "cutoff").agg(F.count("*").alias("n_trades"), rounded(F.sum("net_margin"), 2).alias("total_net_margin"), rounded(F.avg(F.col("was_positive").cast("int")), 4).alias("watchlist_precision"))
    grid = cutoffs.join(F.broadcast(policies), F.lit(True))
    return grid.join(got, ["policy", "cutoff"], "left").select("policy", "cutoff", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_trades", "total_net_margin", "watchlist_precision")))
