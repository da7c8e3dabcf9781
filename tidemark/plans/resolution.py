"""Registered queries of entity resolution, loading, data quality and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import rounded
from tidemark.operators import marts, resolution, warehouse
from tidemark.operators.graph import stored
from tidemark.plans import text
from tidemark.plans.oracle import CTE, r, with_
from tidemark.sources import extract
from tidemark.sources import testdata as src


def _items(s, d):
    """Normalised listings as a stored relation: pairs, components and reports all read it."""
    return stored(text.different(text.titles(s, d)).select("id", "title", "title_normalized", "listing_url", "brand", "category", "season", "price_cents", "model_line", "era", "colorway", "colorway_tier"))


def _members(items):
    return items.join(resolution.items_of(items), "id")


def _borderline(items):
    return resolution.scored_pairs(items, resolution.BORDERLINE, resolution.MATCH).select("left_id", "right_id", "score")


def _breakdown(s, d):
    """The signals behind the pairs at or over the borderline: how many have each, and their means."""
    pairs = resolution.counted_pairs(_items(s, d), resolution.BORDERLINE)
    parts = pairs.select((F.col("score") >= resolution.MATCH).alias("is_match"), "n", F.explode("breakdown").alias("signal", "value"))
    return parts.groupBy("is_match", "signal").agg(F.sum("n").alias("n"), rounded(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean_value"))


def _report(s, d):
    items = _items(s, d)
    return resolution.catalog_report(resolution.propagate(_members(items)), resolution.counted_pairs(items, resolution.BORDERLINE, resolution.MATCH))


def _landed(s, d):
    """Listings with a key that repeats, and NULL for the fifth grade."""
    x = src.listings(s, d)
    return x.select("platform_id", F.when(F.col("condition_ordinal") != 5, F.col("listing_url")).alias("listing_url"), "listed_date", "asking_cents", "condition_ordinal")


def _load(s, d):
    x = _landed(s, d)
    return warehouse.insert_if_absent(x, x.where("condition_ordinal = 2"), ["platform_id", "listing_url"], ["listed_date", "asking_cents"])


def _domain(s, d):
    x = marts.listings_usd(s, d)
    return warehouse.violation_counts(x, {
        "price_positive": F.col("asking_usd") > 0, "condition_range": F.col("condition_ordinal").between(1, 5), "sold_price_means_sold": F.col("sold_cents").isNull() | F.col("is_sold"),
        "known_currency": F.col("currency").isin("USD", "EUR", "GBP", "JPY"), "usd_present": F.col("asking_usd").isNotNull(),
    })


QUERIES = {
    "block_pairs": lambda s, d: resolution.pair_counts(_items(s, d)),
    "block_stats": lambda s, d: resolution.blocks(_items(s, d)).groupBy("block").agg(F.count("*").alias("n_listings")),
    "pair_scores": lambda s, d: resolution.scored_pairs(_items(s, d), 0.0).select("left_id", "right_id", "score"),
    "borderline_pairs": lambda s, d: _borderline(_items(s, d)),
    "pair_breakdown": _breakdown,
    "item_components": lambda s, d: _members(_items(s, d)).select("id", "component"),
    "item_attributes": lambda s, d: resolution.item_attributes(_members(_items(s, d))),
    "family_propagation": lambda s, d: resolution.propagate(_members(_items(s, d))).select("id", "model_line", "era"),
    "family_members": lambda s, d: resolution.family_members(resolution.propagate(_members(_items(s, d)))),
    "family_catalog": lambda s, d: resolution.family_catalog(resolution.propagate(_members(_items(s, d)))),
    "catalog_report": _report,
    "idempotent_load": _load,
    "unique_violations": lambda s, d: warehouse.unique_violations(_landed(s, d), ["platform_id", "listing_url"]),
    "first_seen": lambda s, d: warehouse.first_seen(src.listings(s, d), "family_id"),
    "fk_violations": lambda s, d: warehouse.orphans(src.table(s, d, "lineitem"), "l_orderkey", src.table(s, d, "orders").where("o_orderstatus <> 'F'"), "o_orderkey").groupBy("l_linenumber").agg(F.count("*").alias("n_orphans")),
    "domain_violations": _domain,
    "html_links": lambda s, d: extract.links(src.table(s, d, "pages")),
    "html_title": lambda s, d: extract.first_tag(src.table(s, d, "pages"), "title"),
    "html_script_call": lambda s, d: extract.script_value(src.table(s, d, "pages"), r"track\((\d+)\)"),
    "json_props": lambda s, d: extract.props(src.table(s, d, "events")).groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum(rounded(F.col("value") * 100, 0).cast("long")).alias("cents")),
    "union_sources": lambda s, d: _union(s, d),
    "latest_snapshot": lambda s, d: _latest(s, d),
}


def _union(s, d):
    """Listings of six sources as one relation, then their counts."""
    x = src.listings(s, d)
    out = None
    for p in range(1, 7):
        one = x.where(F.col("platform_id") == p).select(F.lit(p).alias("source_id"), "asking_cents")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("asking_cents").alias("cents"))


def _latest(s, d):
    """The newest landing of each platform: a month is one landing."""
    x = src.listings(s, d).withColumn("run", F.date_format("listed_date", "yyyy-MM"))
    newest = x.groupBy("platform_id").agg(F.max("run").alias("run"))
    return x.join(newest, ["platform_id", "run"]).groupBy("platform_id", "run").agg(F.count("*").alias("n"))


_WORDS = lambda t: f"list_sort(list_distinct(list_filter(string_split({t}, ' '), lambda x: x <> '')))"
_LESS = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
_JOIN = lambda x: f"coalesce(array_to_string({x}, ' '), '')"
#: Longest common subsequence of lef and rig: one row of bits, moved on by each character of rig.
_LCS = """len(lef) - coalesce(bit_count(list_reduce(list_prepend((1::HUGEINT << len(lef)) - 1, list_transform(string_split(rig, ''), lambda c: coalesce(list_sum(list_transform(range(len(lef)), lambda i: CASE WHEN lef[i + 1] = c THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END)), 0)::HUGEINT)),
    lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & ((1::HUGEINT << len(lef)) - 1))), 0)"""
CTE.update({
    "blocked": "SELECT *, coalesce(title_normalized, '') AS tit, CASE WHEN brand IS NOT NULL OR category IS NOT NULL THEN coalesce(brand, '__unknown_brand__') || '|' || coalesce(category, '__unknown_category__') END AS block FROM famed",
    "worded": f"SELECT DISTINCT block, tit, {_WORDS('tit')} AS w, least(1.0::DOUBLE, len(list_filter(string_split(tit, ' '), lambda x: x <> '')) / 3.0::DOUBLE) AS g FROM blocked WHERE block IS NOT NULL",
    "parted": f"SELECT a.block, a.tit AS lt, b.tit AS rt, least(a.g, b.g) AS g, len(a.w) > 0 AND len(b.w) > 0 AS full_, {_JOIN('list_sort(list_intersect(a.w, b.w))')} AS com, {_JOIN(_LESS('a.w', 'b.w'))} AS lef, {_JOIN(_LESS('b.w', 'a.w'))} AS rig FROM worded a JOIN worded b ON a.block = b.block AND a.tit <= b.tit",
    "rated": f"""SELECT block, lt, rt, CASE WHEN NOT full_ THEN NULL WHEN com <> '' AND (lef = '' OR rig = '') THEN g ELSE g * greatest(1 - (len(lef) + len(rig) - 2 * lcs) / (la + lb), CASE WHEN com <> '' THEN 1 - (la - len(com)) / (len(com) + la) ELSE 0 END, CASE WHEN com <> '' THEN 1 - (lb - len(com)) / (len(com) + lb) ELSE 0 END) END AS ts
        FROM (SELECT *, (len(com) + CASE WHEN com <> '' THEN 1 ELSE 0 END + len(lef))::DOUBLE AS la, (len(com) + CASE WHEN com <> '' THEN 1 ELSE 0 END + len(rig))::DOUBLE AS lb, CASE WHEN lef = '' OR rig = '' THEN 0 ELSE {_LCS} END AS lcs FROM parted)""",
    "ipairs": "SELECT a.block, a.id AS left_id, b.id AS right_id, least(a.tit, b.tit) AS lt, greatest(a.tit, b.tit) AS rt, a.season AS las, b.season AS ras, a.price_cents AS lac, b.price_cents AS rac FROM blocked a JOIN blocked b ON a.block = b.block AND a.id < b.id",
    "signals": """SELECT left_id, right_id, ts, CAST(CAST(las = ras AS INTEGER) AS DOUBLE) AS ss, CASE WHEN lac > 0 AND rac > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (least(lac, rac) / greatest(lac, rac) - 0.2::DOUBLE) / 0.6::DOUBLE)) END AS ps FROM ipairs JOIN rated USING (block, lt, rt)""",
    "scored": f"SELECT left_id, right_id, ts, ss, ps, {r('((0.7 * coalesce(ts, 0) + 0.15 * coalesce(ss, 0) + 0.15 * coalesce(ps, 0)) / (CASE WHEN ts IS NULL THEN 0 ELSE 0.7 END + CASE WHEN ss IS NULL THEN 0 ELSE 0.15 END + CASE WHEN ps IS NULL THEN 0 ELSE 0.15 END))', 6)} AS score FROM signals",
    "landed": "SELECT platform_id, CASE WHEN condition_ordinal <> 5 THEN listing_url END AS listing_url, listed_date, asking_cents, condition_ordinal FROM listings",
})

ORACLES = {
    "block_pairs": with_("SELECT block, sum(n * (n - 1) // 2)::BIGINT AS n_pairs FROM (SELECT block, count(*) AS n FROM blocked WHERE block IS NOT NULL GROUP BY 1) WHERE n > 1 GROUP BY 1"),
    "block_stats": with_("SELECT block, count(*) AS n_listings FROM blocked GROUP BY 1"),
    "pair_scores": with_("SELECT left_id, right_id, score FROM scored WHERE score >= 0"),
    "borderline_pairs": with_("SELECT left_id, right_id, score FROM scored WHERE score >= 0.55 AND score < 0.7"),
    "pair_breakdown": with_(f"SELECT score >= 0.7 AS is_match, signal, count(*) AS n, {r('avg(v)', 6)} AS mean_value FROM (SELECT score, 'title' AS signal, ts AS v FROM scored UNION ALL SELECT score, 'season', ss FROM scored UNION ALL SELECT score, 'price', ps FROM scored) WHERE score >= 0.55 AND v IS NOT NULL GROUP BY 1, 2"),
    "idempotent_load": with_("SELECT * FROM landed WHERE listing_url IS NULL UNION ALL SELECT platform_id, listing_url, listed_date, asking_cents, condition_ordinal FROM (SELECT *, row_number() OVER (PARTITION BY platform_id, listing_url ORDER BY listed_date, asking_cents) AS n FROM landed WHERE listing_url IS NOT NULL) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM landed e WHERE e.condition_ordinal = 2 AND e.platform_id = x.platform_id AND e.listing_url = x.listing_url)"),
    "unique_violations": with_("SELECT platform_id, listing_url, count(*) AS n FROM landed WHERE listing_url IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"),
    "first_seen": with_("SELECT family_id, min(coalesce(listed_date, sold_date)) AS first_seen_date FROM listings GROUP BY 1"),
    "fk_violations": "SELECT l_linenumber, count(*) AS n_orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') GROUP BY 1",
    "domain_violations": with_(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS n_violations FROM listings_usd" for n, c in {
        "price_positive": "asking_usd > 0", "condition_range": "condition_ordinal BETWEEN 1 AND 5", "sold_price_means_sold": "sold_cents IS NULL OR is_sold", "known_currency": "currency IN ('USD', 'EUR', 'GBP', 'JPY')", "usd_present": "asking_usd IS NOT NULL"}.items())),
    "html_links": """SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)""",
    "html_title": "SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), '') AS title FROM pages",
    "html_script_call": r"SELECT page_id, nullif(regexp_extract(html, '<script[^>]*>[^<]*(?:<[^/][^<]*|</p>[^<]*)*track\((\d+)\)', 1), '') AS found FROM pages",
    "json_props": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, CAST(sum(CAST(sign(value) * floor(abs(value * 100) + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "union_sources": with_("SELECT platform_id AS source_id, count(*) AS n, CAST(sum(asking_cents) AS BIGINT) AS cents FROM listings GROUP BY 1"),
    "latest_snapshot": with_("SELECT platform_id, run, count(*) AS n FROM (SELECT platform_id, strftime(listed_date, '%Y-%m') AS run FROM listings) x WHERE run = (SELECT max(strftime(listed_date, '%Y-%m')) FROM listings y WHERE y.platform_id = x.platform_id) GROUP BY 1, 2"),
}
_EDGES = "near AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM scored WHERE score >= 0.7), edges AS (SELECT * FROM near UNION SELECT b, a FROM near), reach AS (SELECT id AS node, id AS c FROM famed UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.node WHERE r.c < e.b), comp AS (SELECT node AS id, min(c) AS component FROM reach GROUP BY 1)"


def _with_components(body: str) -> str:
    base = with_("SELECT * FROM scored, famed")
    return base.replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("SELECT * FROM scored, famed").rstrip() + f", {_EDGES} " + body


ORACLES |= {
    "item_components": _with_components("SELECT id, component FROM comp"),
    "item_attributes": _with_components("""SELECT component, max_by(title, {'a': len(list_filter(string_split(coalesce(title_normalized, ''), ' '), lambda x: x <> '')), 'b': length(title), 'c': title}) AS canonical_title, min_by(brand, id) FILTER (WHERE brand IS NOT NULL) AS brand,
        min_by(category, id) FILTER (WHERE category IS NOT NULL) AS category, min_by(season, id) FILTER (WHERE season IS NOT NULL) AS season, count(*) AS listing_count, 'item-' || substring(sha1(min(coalesce(nullif(listing_url, ''), title))), 1, 12) AS item_id FROM famed JOIN comp USING (id) GROUP BY 1"""),
}
_FILL = f""", p1 AS (SELECT *, brand IS NOT NULL AND model_line IS NULL AND count(DISTINCT model_line) OVER (PARTITION BY component, brand) = 1 AS fill, max(model_line) OVER (PARTITION BY component, brand) AS one FROM famed JOIN comp USING (id)),
    p2 AS (SELECT id, component, brand, category, colorway, fill, colorway_tier, CASE WHEN fill THEN one ELSE model_line END AS model_line, CASE WHEN fill THEN 'era-unknown' ELSE era END AS era FROM p1),
    p3 AS (SELECT *, count(DISTINCT CASE WHEN era <> 'era-unknown' THEN era END) OVER w AS k, max(CASE WHEN era <> 'era-unknown' THEN era END) OVER w AS e FROM p2 WINDOW w AS (PARTITION BY component, brand, model_line)),
    p4 AS (SELECT id, component, brand, category, model_line, CASE WHEN brand IS NOT NULL AND model_line IS NOT NULL AND era = 'era-unknown' AND k = 1 THEN e ELSE era END AS era,
        CASE WHEN NOT fill THEN colorway_tier WHEN colorway IS NULL THEN 'unknown' WHEN {text._RANK} = 3 THEN 'rare' WHEN {text._RANK} = 2 THEN 'core' ELSE 'standard' END AS colorway_tier FROM p3),
    filled AS (SELECT *, CASE WHEN brand IS NOT NULL AND model_line IS NOT NULL THEN {text._ID} END AS family_id FROM p4) """
_FAMILIES = "SELECT family_id, brand, model_line, era, array_to_string(list_sort(list(DISTINCT colorway_tier)), ',') AS colorway_tiers, count(*) AS listing_count FROM filled WHERE family_id IS NOT NULL GROUP BY ALL"
ORACLES |= {
    "family_propagation": _with_components("").rstrip() + _FILL + "SELECT id, model_line, era FROM filled",
    "family_members": _with_components("").rstrip() + _FILL + "SELECT id, family_id, brand, model_line, era, colorway_tier FROM filled WHERE family_id IS NOT NULL",
    "family_catalog": _with_components("").rstrip() + _FILL + _FAMILIES,
    "catalog_report": _with_components("").rstrip() + _FILL + f"""SELECT *, total_listings - listings_in_families AS model_line_unresolved, coalesce({r('(resolved_listings / (total_listings - unblockable))', 4)}, 0) AS resolution_rate, coalesce({r('(listings_in_families / total_listings)', 4)}, 0) AS family_coverage
        FROM (SELECT count(*) AS total_listings, count(*) FILTER (WHERE brand IS NULL AND category IS NULL) AS unblockable, count(family_id) AS listings_in_families, count(DISTINCT family_id) AS families, count(*) FILTER (WHERE era = 'era-unknown') AS era_unknown_listings FROM filled),
        (SELECT count(*) AS canonical_items, count(*) FILTER (WHERE n > 1) AS multi_listing_items, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS resolved_listings, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT count(*) AS n FROM filled GROUP BY component)),
        (SELECT count(*) AS borderline_pairs FROM scored WHERE score >= 0.55 AND score < 0.7)""",
}
