"""DuckDB twins of the bound relations and models, as common table expressions joined on demand."""

from __future__ import annotations

import re


def r(x: str, places: int) -> str:
    """Half away from zero, by floor."""
    k = float(10**places)
    return f"(sign({x}) * floor(abs({x}) * {k} + 0.5) / {k})"


SLUG = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
G = "CAST(floor((p_size - 1) / 13.0) AS INTEGER)"
FAMILY = f"{SLUG.format('p_brand')} || '__' || {SLUG.format('p_type')} || '__g' || {G}"
CENTS = "CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT)"

CTE: dict[str, str] = {
    "pf": f"SELECT p_partkey, {FAMILY} AS family_id, p_brand FROM part",
    "families": f"""SELECT family_id, brand, category, 'g' || g AS model_line, (['archive-golden', '1990-1994-run', 'recent-wave', 'era-unknown'])[g + 1] AS era,
        CAST((2 * s + n) // (2 * n) AS BIGINT) / 100.0 AS retail_price_usd, collab_flag FROM (SELECT {FAMILY} AS family_id, p_brand AS brand, p_type AS category, {G} AS g,
        CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n, min(p_partkey) % 2 = 0 AS collab_flag FROM part GROUP BY ALL)""",
    "sales": f"""SELECT family_id, CAST(l_shipdate AS DATE) AS sold_date, {CENTS} AS price_cents, {CENTS} / 100.0 AS sold_price_usd,
        CASE l_returnflag WHEN 'R' THEN 'rare' WHEN 'A' THEN 'core' ELSE 'standard' END AS colorway_tier FROM lineitem JOIN pf ON l_partkey = p_partkey""",
    "attention": """SELECT family_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_date, sum(l_quantity) AS search_interest, count(DISTINCT o_custkey) AS social_mentions
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pf ON l_partkey = p_partkey GROUP BY ALL""",
    "events_": """SELECT CASE WHEN l_linenumber = 1 THEN family_id END AS family_id, p_brand AS brand, CAST(o_orderdate AS DATE) AS event_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pf ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber <= 2""",
    "listings": f"""SELECT 'L-' || l_orderkey || '-' || l_linenumber AS listing_url, s_nationkey % 6 + 1 AS platform_id, family_id, CAST(l_shipdate AS DATE) AS listed_date,
        {CENTS} AS asking_cents, (['USD ', 'EUR ', 'GBP ', 'JPY ', 'CHF '])[s_nationkey % 5 + 1] AS currency, l_returnflag <> 'N' AS is_sold,
        CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS sold_date, CASE WHEN l_returnflag = 'R' THEN {CENTS} END AS sold_cents,
        l_linenumber % 5 + 1 AS condition_ordinal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN pf ON l_partkey = p_partkey""",
    "retail": "SELECT p_partkey AS product_id, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CAST(p_partkey % 3 + 7 AS INTEGER) AS platform_id FROM part",
    "platforms": "SELECT * FROM (VALUES (1, 'grailed', 'resale'), (2, 'ebay', 'resale'), (3, 'depop', 'resale'), (4, 'vestiaire', 'resale'), (5, 'therealreal', 'resale'), (6, 'secondstreet', 'resale'), (7, 'shopify', 'retail'), (8, 'ssense', 'retail'), (9, 'saks', 'retail'), (10, 'google_trends', 'search'), (11, 'reddit', 'social')) AS t(platform_id, platform_name, platform_type)",
    "fx": "SELECT currency, CAST(u AS DOUBLE) AS usd_per_unit FROM (VALUES ('USD', 1.0), ('EUR', 1.09), ('GBP', 1.27), ('JPY', 0.0063)) AS t(currency, u)",
    "listings_usd": f"""SELECT l.* EXCLUDE (currency), trim(l.currency) AS currency, platform_name, usd_per_unit, {r('asking_cents / 100.0 * usd_per_unit', 2)} AS asking_usd,
        {r('sold_cents / 100.0 * usd_per_unit', 2)} AS sold_usd FROM listings l JOIN platforms USING (platform_id) LEFT JOIN fx ON trim(l.currency) = fx.currency""",
    "daily": "SELECT family_id, sold_date, cents, n_sales, cents / 100.0 AS sold_price_usd FROM (SELECT family_id, sold_date, CAST((2 * sum(price_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS cents, count(*) AS n_sales FROM sales GROUP BY ALL)",
    "liquidity": f"SELECT *, {r('n_sold / n_listings', 3)} AS sold_through_rate FROM (SELECT family_id, count(*) AS n_listings, count(*) FILTER (WHERE NOT is_sold) AS n_active, count(*) FILTER (WHERE is_sold) AS n_sold FROM listings GROUP BY 1)",
    "baseline": "SELECT brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY price_cents) / 100.0 AS brand_retail_median_usd, count(*) AS n_prices FROM retail GROUP BY 1",
    "velocity": f"""SELECT * EXCLUDE (prev_sold_date), CASE WHEN prev_price_usd > 0 AND days_between_sales > 0 THEN {r('(sold_price_usd - prev_price_usd) / prev_price_usd / days_between_sales * 30', 4)} END AS monthly_price_velocity
        FROM (SELECT *, CAST(sold_date - prev_sold_date AS INTEGER) AS days_between_sales FROM (SELECT *, lag(sold_price_usd) OVER w AS prev_price_usd, lag(sold_date) OVER w AS prev_sold_date FROM daily WINDOW w AS (PARTITION BY family_id ORDER BY sold_date)))""",
    "spread": f"""SELECT family_id, sold_date, sold_price_usd, brand_retail_median_usd AS retail_reference_usd, CASE WHEN brand_retail_median_usd > 0 THEN {r('sold_price_usd / brand_retail_median_usd', 3)} END AS spread_ratio,
        'brand_proxy' AS spread_basis FROM daily JOIN families USING (family_id) LEFT JOIN baseline USING (brand)""",
}


#: Expressions that DuckDB is to evaluate once, before what reads them.
STORED = {"famed", "blocked", "worded", "parted", "rated", "ipairs", "scored"}


def with_(body: str) -> str:
    """The body with exactly the expressions that it needs before it, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"(?<![\w.'])(?<!AS ){name}(?![\w'(])", text) and text is not CTE[name]:
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    return ("WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTE[n]})" for n in needed) + " " if needed else "") + body
