"""Registered queries of text normalisation, family assignment and event detection.

Titles are composed from the part table out of lists that hold every shape the parsers meet, so each
branch of each function occurs at every scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text as t
from tidemark.functions.dates import parse_date
from tidemark.operators import detect
from tidemark.plans.oracle import CTE, SLUG, with_
from tidemark.sources import testdata as src

LISTS = {
    "b": (8, 1, ["RICK OWENS", "Maison Margiela", "Number (N)ine", "UNDERCOVER", "Balenciaga", "Rick Owens DRKSHDW", "erd", "vintage"]),
    "m": (11, 8, ["Geobasket sneakers", "Ramones", "german army trainer", "Future High Top", "Kurt Cobain cardigan", "Scab jacket", "assemblage hoodie", "Ghesquiere bomber", "denim jeans", "leather thing", "GAT replica shoes"]),
    "c": (7, 3, ["black", "black milk", "milk dust", "oxblood", "plain", "gold silver", "White"]),
    "s": (7, 5, ["FW10", "SS03", "03SS", "aw 09", "2013", "x", "1998"]),
    "w": (5, 7, ["size 43", "sz 9", "worn once", "new", "x"]),
    "f": (9, 11, ["worn by Playboi Carti", "kanye", "x", "Travis Scott fit", "A$AP Rocky", "x", "la flame", "Frank Ocean", "x"]),
    "brand_field": (6, 1, ["Rick Owens", None, " DRKSHDW ", "maison martin margiela", "", "Undercover"]),
    "price_text": (6, 1, ["$1,225.00", "£90", "€45.5", "abc", "", "¥12,000"]),
    "size_text": (13, 1, ["US 9", "UK 8", "27.5cm", "43", "9.5", "IT 48", "M", "XL international", "JP 2", "size 42", "sz 10", "50", "EU 43.5"]),
    "condition_text": (9, 1, ["New with tags", "A", "used, some creasing", "Very good", "gently used", "poor", "b", "unknown", "pristine"]),
    "date_text": (5, 1, ["2026-06-14T10:00:00Z", "Jun 14, 2026", "", "bad", "2025-01-02"]),
    "tag": (4, 1, [None, "FW10", "", "97ss"]),
}


def titles(s, d):
    pick = lambda n, step, xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("p_partkey") / step) % n + 1).cast("int"))
    cols = {k: pick(*v) for k, v in LISTS.items()}
    part = src.table(s, d, "part").select("p_partkey", "p_retailprice", *(c.alias(k) for k, c in cols.items()))
    return part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "b", "m", "c", "s", "w").alias("title"), F.concat_ws(" ", "f", "b", "m", "s").alias("post"), *[k for k in LISTS if len(k) > 1], F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("https://shop.example/item/"), F.col("p_partkey").cast("string"))).alias("listing_url"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"))


def described(x):
    """What a title, brand field and tag say: brand, category, season, product words, model line, era, colour and its tier."""
    x = x.withColumns({"brand": t.normalize_brand("brand_field", "title"), "category": t.infer_category("title")})
    x = x.withColumns({"season": t.extract_season("title", "tag"), "title_normalized": t.normalize_title("title", "brand")})
    x = x.withColumns({"model_line": t.model_line("brand", "title_normalized"), "colorway": t.colorway("title_normalized"), "year": t.listing_year("season", "title")})
    return x.withColumns({"era": F.when(F.col("model_line").isNotNull(), t.era("brand", "model_line", "year")), "colorway_tier": t.colorway_tier("brand", "model_line", "colorway")})


def families(s, d):
    """Titles with all of that, and their size and condition."""
    return described(titles(s, d)).withColumns({"size_normalized": t.normalize_size("size_text", "category"), "condition_ordinal": t.normalize_condition("condition_text")})


def different(x):
    """described(x) by a join: each different title, brand field and tag is worked on once, all of them dealt over all cores."""
    key = ["title", "brand_field", "tag"]
    said = described(x.select(*key).distinct().repartition(x.sparkSession.sparkContext.defaultParallelism))
    said = said.select(*(F.col(c).alias(f"said_{c}") if c in key else c for c in said.columns))
    return x.join(said, [F.col(c).eqNullSafe(F.col(f"said_{c}")) for c in key]).drop(*(f"said_{c}" for c in key))


QUERIES = {
    "money_parse": lambda s, d: titles(s, d).select("id", t.parse_money("price_text").alias("price")),
    "date_parse": lambda s, d: titles(s, d).select("id", parse_date("date_text").alias("day")),
    "season_extract": lambda s, d: titles(s, d).select("id", t.extract_season("title", "tag").alias("season")),
    "condition_ordinal": lambda s, d: titles(s, d).select("id", t.normalize_condition("condition_text").alias("condition_ordinal")),
    "category_infer": lambda s, d: titles(s, d).select("id", t.infer_category("title").alias("category")),
    "brand_alias_scan": lambda s, d: titles(s, d).select("id", t.normalize_brand("brand_field", "title").alias("brand")),
    "size_normalize": lambda s, d: families(s, d).select("id", "size_normalized"),
    "title_normalize": lambda s, d: families(s, d).select("id", "title_normalized"),
    "model_line_assign": lambda s, d: families(s, d).select("id", "model_line"),
    "colorway_tier": lambda s, d: families(s, d).select("id", "colorway", "colorway_tier"),
    "era_assign": lambda s, d: families(s, d).select("id", F.col("year").cast("long").alias("year"), "era"),
    "slug_id": lambda s, d: families(s, d).select("id", F.when(F.col("model_line").isNotNull(), t.family_slug("brand", "model_line", "era")).alias("family_id")),
    "comention_events": lambda s, d: detect.co_mentions(titles(s, d).select("id", F.col("post").alias("text"), F.lit("2025-01-01").alias("day"), F.lit("reddit:x").alias("source"))),
}


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " END"


_PICK = {k: f"([{', '.join(map(_q, xs))}])[CAST(floor(p_partkey / {step}) AS BIGINT) % {n} + 1]" for k, (n, step, xs) in LISTS.items()}
_ALIASES = sorted(((a, b) for b, names in vocab.BRANDS.items() for a in names), key=lambda x: -len(x[0]))


def _brand(field: str, text: str) -> str:
    pad = f"' ' || regexp_replace(lower({text}), '[^a-z0-9()é ]', ' ', 'g') || ' '"
    return f"coalesce({_case([(f'lower(trim({field})) = {_q(a)}', _q(b)) for a, b in _ALIASES])}, {_case([(f'contains({pad}, {_q(f" {a} ")})', _q(b)) for a, b in _ALIASES])})"


def _season(text: str) -> str:
    one = lambda p, h, y: f"CASE WHEN regexp_matches({text}, '{p}') THEN replace(upper(regexp_extract({text}, '{p}', {h})), 'AW', 'FW') || regexp_extract({text}, '{p}', {y}) END"
    return f"coalesce({one(r'(?i)\b(fw|ss|aw)\s*(\d{2})\b', 1, 2)}, {one(r'(?i)\b(\d{2})\s*(ss|fw|aw)\b', 2, 1)})"


def _line(brand: str, text: str) -> str:
    branches = []
    for b, lines in vocab.MODEL_LINES.items():
        best = ", ".join(f"coalesce({_case([(f"contains(' ' || {text} || ' ', ' {a} ')", f"{{'n': {len(a)}, 'l': {_q(m)}}}") for a in spec['aliases']])}, {{'n': 0, 'l': ''}})" for m, spec in lines.items())
        branches.append((f"{brand} = {_q(b)}", f"nullif(greatest({best}, {{'n': 0, 'l': ''}}).l, '')"))
    return _case(branches)


def _clean() -> str:
    out = "regexp_replace(lower(title), '[^a-z0-9()é'' ]', ' ', 'g')"
    for name, aliases in vocab.BRANDS.items():
        for a in aliases:
            out = f"replace({out}, CASE WHEN brand IS NULL OR brand = {_q(name)} THEN {_q(a)} ELSE chr(1) END, ' ')"
    noise = ", ".join(map(_q, vocab.NOISE))
    return rf"array_to_string(list_filter(regexp_split_to_array(trim({out}), '\s+'), lambda x: x <> '' AND x NOT IN ({noise}) AND NOT regexp_full_match(x, '\d{{1,2}}(\.\d)?')), ' ')"


def _map(values: dict, key: str) -> str:
    return _case([(f"{key} = {_q(k)}", _q(v)) for k, v in values.items()])


_N = r"(\d{1,2}(?:\.\d)?)"
_T = "trim(replace(lower(trim(size_text)), 'size', ''))"
_X = lambda p: f"nullif(regexp_extract({_T}, '{p}', 1), '')"
_BARE = f"coalesce({_X(rf'^{_N}(?:\s*(?:eu|it))?$')}, {_X(rf'^(?:eu|it)\s*{_N}$')})"
_CM = _X(r"(\d{2}(?:\.\d)?)\s*cm")
_SHOES = _case([
    (f"{_CM} IS NOT NULL", _map(vocab.SHOE_CM, f"CASE WHEN contains({_CM}, '.') THEN regexp_replace({_CM}, '\\.?0+$', '') ELSE regexp_replace({_CM}, '0+$', '') END")),
    (f"{_X(rf'uk\s*{_N}')} IS NOT NULL", _map(vocab.SHOE_UK, _X(rf"uk\s*{_N}"))),
    (f"{_X(rf'(?:us|sz)\s*{_N}')} IS NOT NULL", _map(vocab.SHOE_US, _X(rf"(?:us|sz)\s*{_N}"))),
    (f"CAST({_BARE} AS DOUBLE) BETWEEN 39 AND 48", f"regexp_replace(format('{{:.1f}}', CAST({_BARE} AS DOUBLE)), '\\.0$', '')"),
    (f"CAST({_BARE} AS DOUBLE) BETWEEN 6 AND 14", _map(vocab.SHOE_US, _BARE)),
])
_CLOTHES = f"coalesce(upper({_X(r'^(xxs|xs|s|m|l|xl|xxl)(?:\s*international)?$')}), {_map(vocab.CLOTHES_EU, _X(r'(\d{2})\s*(?:fr|it|eu)?'))}, {_map(vocab.CLOTHES_JP, _X(r'^(?:jp\s*)?([0-5])$'))})"
_COND = "lower(trim(condition_text))"
_TIER = {(b, m, c): {"rare": 3, "core": 2}[v] for b, lines in vocab.TIERS.items() for m, cs in lines.items() for c, v in cs.items()}
_RANK = f"list_max(list_transform(string_split(colorway, '/'), lambda c: {_case([(f'brand = {_q(b)} AND model_line = {_q(m)} AND c = {_q(c)}', str(v)) for (b, m, c), v in _TIER.items()] + [('TRUE', '1')])}))"
_ERA = lambda b, m, y: f"coalesce({_case([(f'{b} = {_q(x)} AND {m} = {_q(l)} AND {y} BETWEEN {a} AND {z}', _q(n)) for x, ls in vocab.MODEL_LINES.items() for l, sp in ls.items() for n, a, z in sp['eras']])}, CAST({y} // 10 * 10 AS VARCHAR) || 's', 'era-unknown')"  # noqa: E731, E741
_PAD = "' ' || regexp_replace(lower(post), '[^a-z0-9()$é ]', ' ', 'g') || ' '"
_YEAR = r"TRY_CAST(nullif(regexp_extract({0}, '\b(19[89][0-9]|20[0-3][0-9])\b', 1), '') AS INTEGER)"

CTE.update({
    "titles": "SELECT p_partkey AS id, b || ' ' || m || ' ' || c || ' ' || s || ' ' || w AS title, f || ' ' || b || ' ' || m || ' ' || s AS post, brand_field, price_text, size_text, condition_text, date_text, tag, CASE WHEN p_partkey % 3 > 0 THEN 'https://shop.example/item/' || p_partkey END AS listing_url, price_cents FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, " + ", ".join(f"{e} AS {k}" for k, e in _PICK.items()) + " FROM part)",
    "branded": f"SELECT *, {_brand('brand_field', 'title')} AS brand, {_case([(' OR '.join(f'contains(lower(title), {_q(k)})' for k in ks), _q(n)) for n, ks in vocab.CATEGORIES])} AS category, coalesce({_season("coalesce(tag, '')")}, {_season('title')}) AS season FROM titles",
    "normed": f"SELECT *, CASE WHEN size_text <> '' THEN CASE WHEN category = 'footwear' THEN {_SHOES} ELSE {_CLOTHES} END END AS size_normalized, {_clean()} AS title_normalized FROM branded",
    "lined": f"SELECT *, {_line('brand', 'title_normalized')} AS model_line, coalesce(CASE WHEN season IS NOT NULL THEN CAST(season[3:4] AS INTEGER) + CASE WHEN CAST(season[3:4] AS INTEGER) < 90 THEN 2000 ELSE 1900 END END, {_YEAR.format('title')}) AS year, nullif(array_to_string(list_distinct_ordered[1:2], '/'), '') AS colorway FROM (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(title_normalized, ' '), lambda x: x IN ({', '.join(map(_q, vocab.COLOURS))})), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered FROM normed)",
    "famed": f"SELECT *, CASE WHEN model_line IS NOT NULL THEN {_ERA('brand', 'model_line', 'year')} END AS era, CASE WHEN colorway IS NULL THEN 'unknown' WHEN {_RANK} = 3 THEN 'rare' WHEN {_RANK} = 2 THEN 'core' ELSE 'standard' END AS colorway_tier FROM lined",
    "posts": f"SELECT id, post, {_case([(' OR '.join(f'contains({_PAD}, {_q(f" {a} ")})' for a in names), _q(n)) for n, names in vocab.FIGURES.items()])} AS figure, {_brand('NULL', 'post')} AS brand, {_season('post')} AS season FROM titles",
    "mentions": f"SELECT *, {_line('brand', f'trim({_PAD})')} AS model_line, coalesce(CASE WHEN CAST(season[3:4] AS INTEGER) < 90 THEN 2000 + CAST(season[3:4] AS INTEGER) END, {_YEAR.format('post')}) AS year FROM posts WHERE figure IS NOT NULL AND brand IS NOT NULL",
})
_ID = " || '__' || ".join(SLUG.format(c) for c in ("brand", "model_line", "era"))

ORACLES = {
    "money_parse": with_("SELECT id, TRY_CAST(regexp_replace(replace(trim(price_text), ',', ''), '^[$€£¥]+', '') AS DOUBLE) AS price FROM titles"),
    "date_parse": with_("SELECT id, coalesce(TRY_CAST(substring(trim(date_text), 1, 10) AS DATE), CAST(try_strptime(trim(date_text), '%b %d, %Y') AS DATE)) AS day FROM titles"),
    "season_extract": with_("SELECT id, season FROM branded"),
    "condition_ordinal": with_(f"SELECT id, CASE WHEN {_COND} <> '' THEN {_case([(f'{_COND} = {_q(k)}', str(v)) for k, v in vocab.CONDITION_LETTERS.items()] + [(' OR '.join(f'contains({_COND}, {_q(p)})' for p in ps), str(v)) for v, ps in vocab.CONDITIONS])} END AS condition_ordinal FROM titles"),
    "category_infer": with_("SELECT id, category FROM branded"),
    "brand_alias_scan": with_("SELECT id, brand FROM branded"),
    "size_normalize": with_("SELECT id, size_normalized FROM normed"),
    "title_normalize": with_("SELECT id, title_normalized FROM normed"),
    "model_line_assign": with_("SELECT id, model_line FROM lined"),
    "colorway_tier": with_("SELECT id, colorway, colorway_tier FROM famed"),
    "era_assign": with_("SELECT id, CAST(year AS BIGINT) AS year, era FROM famed"),
    "slug_id": with_(f"SELECT id, CASE WHEN model_line IS NOT NULL THEN {_ID} END AS family_id FROM famed"),
    "comention_events": with_(f"SELECT id, figure, brand, model_line, CASE WHEN model_line IS NOT NULL AND year IS NOT NULL THEN {_ID} END AS family_id, '2025-01-01' AS event_date, 'reddit:x' AS source, CASE WHEN model_line IS NOT NULL THEN 0.9 ELSE 0.6 END AS confidence, substring(post, 1, 200) AS evidence FROM (SELECT *, {_ERA('brand', 'model_line', 'year')} AS era FROM mentions)"),
}
