"""Registered queries of labels, features, pricing, backtest and metrics."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions.stats import rounded
from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import metrics, ml, pricing
from tidemark.operators.graph import stored
from tidemark.plans.oracle import CTE, r, with_
from tidemark.sources import testdata as src

POLICIES = [("model",), ("search",), ("none",)]


def _labels(s, d):
    return lab.labels(src.sales(s, d), src.attention(s, d), src.families(s, d))


def _cells(s, d):
    """Every labelled (family, moment) with its label."""
    return _labels(s, d).select("family_id", "prediction_moment", "label")


def _features(s, d):
    """The feature contract over all labelled cells; these are stored, since every group of features joins them."""
    return feat.features(stored(_cells(s, d)), src.sales(s, d), src.attention(s, d), src.families(s, d), src.celebrity_events(s, d))


def _rounded(df, places=6):
    """Doubles to six places: sums of doubles differ in their last bits between engines."""
    return df.select(*(rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def predictions(s, d):
    """A surrogate score from the search slope at every labelled cell; any model's scores have this shape."""
    cells = _cells(s, d)
    a = feat.attention_features(cells, src.attention(s, d))
    slope = rounded(F.when(F.col("interest_30_60") > 0, F.col("interest_0_30") / F.col("interest_30_60") - 1), 6)
    out = cells.join(a, feat.KEY, "left").withColumn("search_slope_60d", slope)
    score = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("search_slope_60d") / 2 + 0.5)), 6)
    return out.select("family_id", F.col("prediction_moment").alias("cutoff"), "label", "search_slope_60d", F.when(F.col("search_slope_60d").isNotNull(), score).alias("score"))


def _scored(s, d):
    """Predictions as a stored relation: policies, exits and prices all read it, so it is computed once."""
    return predictions(s, d).persist()


def _trades(s, d):
    return pricing.trades(_scored(s, d), src.sales(s, d))


def _fades(p):
    return pricing.exits(pricing.watchlist(p), p).select("policy", "cutoff", "family_id", "sell_on", "days_held", "sold_on_fade")


def _asks(s, d):
    return _cells(s, d).select("family_id", F.col("prediction_moment").alias("as_of"))


def _graded(s, d):
    return src.listings(s, d).where("is_sold").select("family_id", "sold_date", F.col("asking_cents").alias("price_cents"), "condition_ordinal")


def _per_cutoff(s, d):
    p = _scored(s, d)
    return pricing.per_cutoff(pricing.trades(p, src.sales(s, d)), pricing.usable_cutoffs(p, src.sales(s, d)).select("cutoff").distinct(), src.values(s, POLICIES, "policy"))


def _gbt(s, d):
    """Scores of a boosted-tree model on the moments from 1999 on; trained on those before."""
    rows = _features(s, d).persist()
    model = ml.train(rows.where("prediction_moment < '1999-01-01'"))
    return ml.scores(model, rows.where("prediction_moment >= '1999-01-01'"))


QUERIES = {
    "gbt_scores": _gbt,
    "prediction_moments": lambda s, d: lab.moments(src.sales(s, d)),
    "family_windows": lambda s, d: _rounded(lab.windows(src.sales(s, d), src.attention(s, d))),
    "labels": _labels,
    "label_peer_basis_counts": lambda s, d: lab.summary(_labels(s, d)),
    "label_exclusions": lambda s, d: lab.exclusions(src.sales(s, d), src.attention(s, d), src.families(s, d)),
    "threshold_grid": lambda s, d: lab.threshold_grid(_labels(s, d)),
    "sales_features": lambda s, d: feat.sales_features(_cells(s, d), src.sales(s, d)),
    "attention_features": lambda s, d: _rounded(feat.attention_features(_cells(s, d), src.attention(s, d))),
    "celebrity_signal": lambda s, d: feat.celebrity_signal(_cells(s, d), src.families(s, d), src.celebrity_events(s, d)),
    "features_full": lambda s, d: _rounded(_features(s, d)),
    "lookahead_violations": lambda s, d: feat.lookahead_violations(_features(s, d)),
    "feature_range_violations": lambda s, d: feat.range_violations(_features(s, d)),
    "predictions": predictions,
    "worth_estimate": lambda s, d: pricing.worth(_asks(s, d), src.sales(s, d)),
    "worth_by_tier": lambda s, d: pricing.worth(_asks(s, d), src.sales(s, d), tier="rare"),
    "condition_adjusted_worth": lambda s, d: pricing.worth(_asks(s, d), _graded(s, d), condition=True),
    "watchlist_topk": lambda s, d: pricing.watchlist(_scored(s, d)).select("policy", "cutoff", "family_id", F.col("rank").cast("long").alias("rank")),
    "first_fade": lambda s, d: _fades(_scored(s, d)),
    "trades": _trades,
    "policy_summary": lambda s, d: pricing.policy_summary(_trades(s, d), src.values(s, POLICIES, "policy")),
    "per_cutoff": _per_cutoff,
    "precision_recall_at_k": lambda s, d: metrics.at_k(_scored(s, d)),
    "confusion_at_half": lambda s, d: metrics.confusion(predictions(s, d)),
    "pr_auc": lambda s, d: metrics.average_precision(predictions(s, d).where("score is not null")),
    "time_split_counts": lambda s, d: predictions(s, d).groupBy((F.col("cutoff") < "1999-01-01").alias("in_train")).agg(F.count("*").alias("n_rows"), F.count_if("label").alias("positives")),
}

_U = "(0.5 * coalesce(lp, 0) + 0.3 * lv + 0.2 * coalesce(li, 0)) / (CASE WHEN lp IS NULL THEN 0.0 ELSE 0.5 END + 0.3 + CASE WHEN li IS NULL THEN 0.0 ELSE 0.2 END)"
CTE.update({
    "moments": "SELECT CAST(m AS DATE) AS prediction_moment FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m, lo, hi FROM (SELECT CAST(min(sold_date) + 60 AS TIMESTAMP) AS lo, CAST(max(sold_date) - 60 AS TIMESTAMP) AS hi FROM sales)) WHERE m >= lo AND m <= hi",
    "sw": """SELECT family_id, prediction_moment, median(price_cents) FILTER (WHERE sold_date <= prediction_moment) AS base_cents, median(price_cents) FILTER (WHERE sold_date > prediction_moment) AS out_cents,
        count(*) FILTER (WHERE sold_date <= prediction_moment) AS n_base, count(*) FILTER (WHERE sold_date > prediction_moment) AS n_out
        FROM sales JOIN moments ON sold_date > prediction_moment - 60 AND sold_date <= prediction_moment + 60 GROUP BY ALL""",
    "aw": """SELECT family_id, prediction_moment, sum(search_interest) FILTER (WHERE week_date <= prediction_moment) AS bi, sum(search_interest) FILTER (WHERE week_date > prediction_moment) AS oi,
        count(*) FILTER (WHERE week_date <= prediction_moment) AS bw, count(*) FILTER (WHERE week_date > prediction_moment) AS ow
        FROM attention JOIN moments ON week_date > prediction_moment - 60 AND week_date <= prediction_moment + 60 GROUP BY ALL""",
    "measured": f"""SELECT family_id, prediction_moment, base_cents, n_base, n_out, {_U} AS u FROM (SELECT *, CASE WHEN base_cents > 0 AND out_cents > 0 THEN ln(out_cents / base_cents) END AS lp, ln((n_out + 1) / (n_base + 1)) AS lv,
        CASE WHEN bw >= 4 AND ow >= 4 AND bi > 0 AND oi > 0 THEN ln((oi / ow) / (bi / bw)) END AS li FROM sw LEFT JOIN aw USING (family_id, prediction_moment) WHERE n_base >= 2 AND n_out >= 2)""",
    "mf": "SELECT * FROM measured JOIN families USING (family_id)",
    "ladder": """SELECT a.family_id, a.prediction_moment, a.base_cents, a.n_base, a.n_out, a.u,
        list(b.u) FILTER (WHERE b.brand = a.brand AND b.base_cents BETWEEN 0.4 * a.base_cents AND 2.5 * a.base_cents) AS r1, list(b.u) FILTER (WHERE b.brand = a.brand) AS r2, list(b.u) FILTER (WHERE b.base_cents BETWEEN 0.4 * a.base_cents AND 2.5 * a.base_cents) AS r3
        FROM mf a LEFT JOIN mf b ON a.prediction_moment = b.prediction_moment AND a.category = b.category AND a.family_id <> b.family_id GROUP BY ALL""",
    "rung": "SELECT *, CASE WHEN len(r1) >= 3 THEN 'brand' WHEN len(r2) >= 3 THEN 'brand_wide' WHEN len(r3) >= 3 THEN 'category' END AS peer_basis, CASE WHEN len(r1) >= 3 THEN r1 WHEN len(r2) >= 3 THEN r2 WHEN len(r3) >= 3 THEN r3 END AS pu FROM ladder",
    "zs": "SELECT *, (u - med) / greatest(1.4826 * mad, 0.05) AS z, exp(u) - exp(med) AS edge FROM (SELECT *, list_median(list_transform(pu, lambda x: abs(x - med))) AS mad FROM (SELECT *, list_median(pu) AS med FROM rung WHERE peer_basis IS NOT NULL))",
    "labelled": f"SELECT family_id, prediction_moment, base_cents / 100.0 AS baseline_price_usd, {r('u', 4)} AS log_uplift, {r('med', 4)} AS peer_median_log_uplift, {r('z', 3)} AS peer_z, {r('edge', 4)} AS uplift_edge, len(pu) AS n_peers, peer_basis, n_base AS n_baseline_sales, n_out AS n_outcome_sales, z >= 2.0 AND edge >= 0.15 AS label FROM zs",
    "cells": "SELECT family_id, prediction_moment, label FROM labelled",
    "sf": """SELECT family_id, prediction_moment, quantile_disc(sold_price_usd, 0.5) FILTER (WHERE sold_date > prediction_moment - 30) AS median_recent,
        quantile_disc(sold_price_usd, 0.5) FILTER (WHERE sold_date <= prediction_moment - 30 AND sold_date > prediction_moment - 90) AS median_prior, quantile_disc(sold_price_usd, 0.5) FILTER (WHERE sold_date > prediction_moment - 90) AS median_90d,
        quantile_disc(sold_price_usd, 0.5) FILTER (WHERE sold_date > prediction_moment - 90 AND colorway_tier = 'rare') AS rare_median_90d, count(*) FILTER (WHERE sold_date > prediction_moment - 90) AS n_sales_90d, max(sold_date) AS max_sales_date_used
        FROM cells JOIN sales USING (family_id) WHERE sold_date > prediction_moment - 120 AND sold_date <= prediction_moment GROUP BY ALL""",
})


def _attention(cells: str) -> str:
    recent, mid, old = "week_date > prediction_moment - 30", "week_date <= prediction_moment - 30 AND week_date > prediction_moment - 60", "week_date <= prediction_moment - 60"
    return f"""SELECT family_id, prediction_moment, avg(search_interest) FILTER (WHERE {recent}) AS interest_0_30, avg(search_interest) FILTER (WHERE {mid}) AS interest_30_60, avg(search_interest) FILTER (WHERE {old}) AS interest_60_90,
        avg(social_mentions) FILTER (WHERE {recent}) AS mentions_0_30, avg(social_mentions) FILTER (WHERE {mid}) AS mentions_30_60, max(week_date) AS max_attention_date_used
        FROM {cells} JOIN attention USING (family_id) WHERE week_date > prediction_moment - 90 AND week_date <= prediction_moment GROUP BY ALL"""


_Z = lambda c: f"CASE WHEN stddev({c}) OVER w > 0 AND count(family_id) OVER w >= 3 THEN ({c} - avg({c}) OVER w) / stddev({c}) OVER w END AS {c}_peer_z"
CTE.update({
    "af": _attention("cells"),
    "cs": """SELECT family_id, prediction_moment, count(*) AS celebrity_event_count_90d, max(event_date) AS max_event_date_used FROM (SELECT c.family_id, prediction_moment, e.event_date FROM cells c JOIN families f USING (family_id)
        JOIN events_ e ON (e.family_id = c.family_id OR (e.family_id IS NULL AND e.brand = f.brand)) AND e.event_date > prediction_moment - 90 AND e.event_date <= prediction_moment) GROUP BY ALL""",
    "fb": """SELECT family_id, prediction_moment, year(prediction_moment) AS prediction_year, label, CASE WHEN median_prior > 0 THEN median_recent / median_prior - 1 END AS price_momentum_60d, coalesce(n_sales_90d, 0) / 3.0 AS sold_velocity_30d,
        CASE WHEN retail_price_usd > 0 THEN median_90d / retail_price_usd END AS spread_at_cutoff, CASE WHEN median_90d > 0 THEN rare_median_90d / median_90d - 1 END AS rare_tier_premium,
        CASE WHEN interest_30_60 > 0 THEN interest_0_30 / interest_30_60 - 1 END AS search_slope_60d, CASE WHEN interest_30_60 > 0 THEN interest_0_30 / interest_30_60 - 1 END - CASE WHEN interest_60_90 > 0 THEN interest_30_60 / interest_60_90 - 1 END AS search_accel,
        (coalesce(mentions_0_30, 0.0) + 1) / (coalesce(mentions_30_60, 0.0) + 1) - 1 AS social_velocity_60d, coalesce(celebrity_event_count_90d, 0) AS celebrity_event_count_90d, CAST(prediction_moment - max_event_date_used AS DOUBLE) AS celebrity_recency_days,
        brand, category, collab_flag, coalesce(CASE WHEN era LIKE 'archive%' THEN TRUE WHEN era LIKE 'recent%' THEN FALSE ELSE year(prediction_moment) - TRY_CAST(nullif(regexp_extract(era, '(19[89][0-9]|20[0-3][0-9])', 1), '') AS INTEGER) >= 5 END, FALSE) AS archive_flag,
        greatest(max_sales_date_used, max_attention_date_used, max_event_date_used) AS max_source_date_used
        FROM cells LEFT JOIN sf USING (family_id, prediction_moment) LEFT JOIN af USING (family_id, prediction_moment) LEFT JOIN cs USING (family_id, prediction_moment) LEFT JOIN families USING (family_id)""",
    "ff": f"SELECT *, {', '.join(_Z(c) for c in feat.PEER_FEATURES)}, count(family_id) OVER w AS peer_group_size FROM fb WINDOW w AS (PARTITION BY prediction_moment, category)",
    "paf": _attention("labelled"),
    "preds": f"""SELECT family_id, cutoff, label, search_slope_60d, CASE WHEN search_slope_60d IS NOT NULL THEN {r('greatest(0.0, least(1.0, search_slope_60d / 2 + 0.5))', 6)} END AS score FROM (
        SELECT family_id, prediction_moment AS cutoff, label, CASE WHEN interest_30_60 > 0 THEN {r('(interest_0_30 / interest_30_60 - 1)', 6)} END AS search_slope_60d FROM labelled LEFT JOIN paf USING (family_id, prediction_moment))""",
    "bought_all": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy, cutoff ORDER BY by_ DESC, family_id) AS rank FROM (SELECT 'model' AS policy, cutoff, family_id, score AS by_, label FROM preds WHERE score >= 0.5
        UNION ALL SELECT 'search', cutoff, family_id, search_slope_60d, label FROM preds WHERE search_slope_60d > 0)) WHERE rank <= 5""",
    "usable": "SELECT * FROM preds WHERE cutoff + 120 <= (SELECT max(sold_date) FROM sales)",
})
CTE["bought"] = CTE["bought_all"].replace("preds", "usable")


def _exits(source: str) -> str:
    return f"""SELECT b.policy, b.cutoff, b.family_id, any_value(b.label) AS label, coalesce(min(moment), b.cutoff + 120) AS sell_on, coalesce(CAST(min(moment) - b.cutoff AS INTEGER), 120) AS days_held, coalesce(min(moment) - b.cutoff < 120, FALSE) AS sold_on_fade
        FROM {source} b LEFT JOIN (SELECT w.policy, w.cutoff, w.family_id, moment FROM {source} w JOIN (SELECT DISTINCT cutoff AS moment FROM preds) g ON moment > w.cutoff LEFT JOIN preds p ON p.family_id = w.family_id AND p.cutoff = moment
        WHERE moment - w.cutoff >= 120 OR p.score IS NULL OR p.score < 0.5) m ON m.policy = b.policy AND m.cutoff = b.cutoff AND m.family_id = b.family_id GROUP BY b.policy, b.cutoff, b.family_id"""


def _worth(asks: str, comps: str, price: str = "CAST(price_cents AS DOUBLE)", where: str = "TRUE") -> str:
    q = ", ".join(f"{r(f'q[{i}] / 100', 4)} AS {n}" for i, n in enumerate(("p25", "median", "p75"), 1))
    return f"SELECT family_id, as_of, n_comps, {q} FROM (SELECT family_id, as_of, count(*) AS n_comps, quantile_cont({price}, [0.25, 0.5, 0.75]) AS q FROM (SELECT DISTINCT family_id, as_of FROM {asks}) JOIN {comps} USING (family_id) WHERE sold_date > as_of - 60 AND sold_date <= as_of AND {where} GROUP BY ALL) WHERE n_comps >= 3"


CTE.update({
    "exits_all": _exits("bought_all"),
    "exits_": _exits("bought"),
    "sells": "SELECT *, least(sell_on, (SELECT max(sold_date) FROM sales)) AS sell_date FROM exits_",
    "tasks": "SELECT family_id, cutoff AS as_of FROM sells UNION SELECT family_id, sell_date FROM sells",
    "prices": _worth("tasks", "sales"),
    "traded": f"""SELECT policy, cutoff, family_id, {r('buy', 2)} AS buy_price, {r('sell', 2)} AS sell_price, sell_date, days_held, sold_on_fade, label AS was_positive, {r('(sell * (1.0 - 0.12) - buy - 0.0 * days_held)', 2)} AS net_margin, {r('((sell * (1.0 - 0.12) - buy - 0.0 * days_held) / buy)', 4)} AS return_pct
        FROM (SELECT s.*, b.median AS buy, coalesce(e.median, b.median) AS sell FROM sells s JOIN prices b ON b.family_id = s.family_id AND b.as_of = s.cutoff LEFT JOIN prices e ON e.family_id = s.family_id AND e.as_of = s.sell_date)""",
    "asks": "SELECT family_id, prediction_moment AS as_of FROM cells",
    "graded": "SELECT family_id, sold_date, asking_cents AS price_cents, condition_ordinal FROM listings WHERE is_sold",
    "topk": "SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, family_id, cutoff) AS place FROM preds",
    "steps": "SELECT score, count(*) FILTER (WHERE label) AS tp, count(*) AS n FROM preds WHERE score IS NOT NULL GROUP BY 1",
})
_AGG = {"total_net_margin": ("sum(net_margin)", 2), "mean_net_margin": ("avg(net_margin)", 2), "mean_return_pct": ("avg(return_pct)", 4), "watchlist_precision": ("avg(CAST(was_positive AS INTEGER))", 4), "mean_days_to_sell": ("avg(days_held)", 1), "mean_price_realization": ("avg(sell_price / buy_price)", 4), "sold_on_fade_rate": ("avg(CAST(sold_on_fade AS INTEGER))", 4)}
_SUMS = "count(t.family_id) AS n_trades, " + ", ".join(f"coalesce({r(x, p)}, 0) AS {n}" for n, (x, p) in _AGG.items())
_FEATURES = [(c, c in ("price_momentum_60d", "sold_velocity_30d", "spread_at_cutoff", "rare_tier_premium", "search_slope_60d", "search_accel", "social_velocity_60d", "celebrity_recency_days") or c.endswith("_z")) for c in feat.COLUMNS]
_BAD = lambda lo, hi, c: " OR ".join([f"{c} < {lo}"] * (lo is not None) + [f"{c} > {hi}"] * (hi is not None))

ORACLES = {
    "prediction_moments": with_("SELECT * FROM moments"),
    "family_windows": with_(f"SELECT family_id, prediction_moment, {r('base_cents', 6)} AS base_cents, n_base, n_out, {r('u', 6)} AS u FROM measured"),
    "labels": with_("SELECT * FROM labelled"),
    "label_peer_basis_counts": with_("SELECT peer_basis, count(*) AS n_rows, count(DISTINCT family_id) AS n_families, count(*) FILTER (WHERE label) AS n_positive FROM labelled GROUP BY 1"),
    "label_exclusions": with_("SELECT (SELECT count(*) FROM moments) * (SELECT count(*) FROM families) - count(*) AS thin, count(*) FILTER (WHERE peer_basis IS NULL) AS peerless, count(peer_basis) AS labelled FROM rung"),
    "threshold_grid": with_("SELECT z AS z_threshold, e AS min_edge, count(*) FILTER (WHERE peer_z >= z AND uplift_edge >= e) AS n_positive, count(*) AS n_rows FROM labelled, (VALUES (1.5::DOUBLE), (2.0), (2.5)) AS a(z), (VALUES (0.10::DOUBLE), (0.15), (0.25)) AS b(e) GROUP BY ALL"),
    "sales_features": with_("SELECT * FROM sf"),
    "attention_features": with_(f"SELECT family_id, prediction_moment, max_attention_date_used, {', '.join(f'{r(c, 6)} AS {c}' for c in ('interest_0_30', 'interest_30_60', 'interest_60_90', 'mentions_0_30', 'mentions_30_60'))} FROM af"),
    "celebrity_signal": with_("SELECT * FROM cs"),
    "features_full": with_(f"SELECT {', '.join(f'{r(c, 6)} AS {c}' if d else c for c, d in _FEATURES)} FROM ff"),
    "lookahead_violations": with_("SELECT count(*) FILTER (WHERE max_source_date_used > prediction_moment) AS n_violations, count(*) AS n_rows FROM ff"),
    "feature_range_violations": with_(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_BAD(lo, hi, c)}) AS n_violations FROM ff" for c, (lo, hi) in feat.BOUNDS.items())),
    "predictions": with_("SELECT * FROM preds"),
    "worth_estimate": with_(_worth("asks", "sales")),
    "worth_by_tier": with_(_worth("asks", "sales", where="colorway_tier = 'rare'")),
    "condition_adjusted_worth": with_(_worth("asks", "graded", price="price_cents / coalesce(greatest(0.4, 1 - 0.08 * (5 - condition_ordinal)), 1.0)::DOUBLE")),
    "watchlist_topk": with_("SELECT policy, cutoff, family_id, rank FROM bought_all"),
    "first_fade": with_("SELECT policy, cutoff, family_id, sell_on, days_held, sold_on_fade FROM exits_all"),
    "trades": with_("SELECT * FROM traded"),
    "policy_summary": with_(f"SELECT p.policy, {_SUMS} FROM (VALUES ('model'), ('search'), ('none')) AS p(policy) LEFT JOIN traded t USING (policy) GROUP BY 1"),
    "per_cutoff": with_(f"SELECT p.policy, c.cutoff, count(t.family_id) AS n_trades, coalesce({r('sum(net_margin)', 2)}, 0) AS total_net_margin, coalesce({r('avg(CAST(was_positive AS INTEGER))', 4)}, 0) AS watchlist_precision FROM (SELECT DISTINCT cutoff FROM usable) c CROSS JOIN (VALUES ('model'), ('search'), ('none')) AS p(policy) LEFT JOIN traded t ON t.policy = p.policy AND t.cutoff = c.cutoff GROUP BY 1, 2"),
    "precision_recall_at_k": with_(f"SELECT k, count(*) FILTER (WHERE place <= k AND label) AS hits, {r('count(*) FILTER (WHERE place <= k AND label) / nullif(count(*) FILTER (WHERE place <= k), 0)', 6)} AS precision, {r('count(*) FILTER (WHERE place <= k AND label) / nullif(count(*) FILTER (WHERE label), 0)', 6)} AS recall FROM topk, (VALUES (5), (10), (20)) AS t(k) GROUP BY k"),
    "confusion_at_half": with_(f"SELECT n_rows, positives, tp, fp, coalesce({r('tp / nullif(tp + fp, 0)', 6)}, 0) AS precision, coalesce({r('tp / nullif(positives, 0)', 6)}, 0) AS recall FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE label) AS positives, count(*) FILTER (WHERE score >= 0.5 AND label) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT label) AS fp FROM preds)"),
    "pr_auc": with_(f"SELECT {r('coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0)', 6)} AS average_precision, CAST(sum(tp) AS BIGINT) AS positives FROM (SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn FROM steps)"),
    "time_split_counts": with_("SELECT cutoff < DATE '1999-01-01' AS in_train, count(*) AS n_rows, count(*) FILTER (WHERE label) AS positives FROM preds GROUP BY 1"),
}
