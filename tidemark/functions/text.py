"""Text normalisation as column expressions: no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocab

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without one."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def first_of(pairs: list[tuple[Column, object]]) -> Column:
    """The value of the first condition that holds, else NULL."""
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def slug(x: ColumnOrName) -> Column:
    """Lower case, other characters than a-z and 0-9 to single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def family_slug(*parts: ColumnOrName) -> Column:
    return F.concat_ws("__", *(slug(p) for p in parts))


def parse_money(x: ColumnOrName) -> Column:
    """Commas dropped, leading currency signs dropped; NULL when nothing numeric is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(x)), ",", ""), r"^[$€£¥]+", "")
    return bare.try_cast("double")


def padded(x: Column, keep: str) -> Column:
    """Folded text between spaces, every character outside `keep` a space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(x), f"[^{keep}]", " "), F.lit(" "))


def normalize_brand(brand: ColumnOrName, title: ColumnOrName) -> Column:
    """Exact alias of the brand field, else the longest alias that stands as words in the title."""
    aliases = sorted(((a, b) for b, names in vocab.BRANDS.items() for a in names), key=lambda x: -len(x[0]))
    exact = F.lower(F.trim(_c(brand)))
    text = padded(F.coalesce(_c(title), F.lit("")), "a-z0-9()é ")
    return F.coalesce(first_of([(exact == a, b) for a, b in aliases]), first_of([(text.contains(f" {a} "), b) for a, b in aliases]))


def infer_category(title: ColumnOrName) -> Column:
    """First category one of whose keywords occurs anywhere in the title."""
    low = F.lower(_c(title))
    return first_of([(reduce(lambda a, b: a | b, (low.contains(k) for k in words)), name) for name, words in vocab.CATEGORIES])


def normalize_condition(x: ColumnOrName) -> Column:
    """Letter grade, else the first scale step one of whose phrases occurs."""
    low = F.lower(F.trim(_c(x)))
    letters = [(low == k, v) for k, v in vocab.CONDITION_LETTERS.items()]
    return F.when(low != "", first_of(letters + [(reduce(lambda a, b: a | b, (low.contains(p) for p in phrases)), step) for step, phrases in vocab.CONDITIONS]))


def _table(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(str(v)) for kv in values.items() for v in kv)), key)


def normalize_size(size: ColumnOrName, category: ColumnOrName) -> Column:
    """Footwear to EU numbers, clothing to letters; NULL rather than a guess.

    A footwear branch that matches but misses its table gives NULL and does not fall through.
    """
    t = F.trim(F.replace(F.lower(F.trim(_c(size))), F.lit("size"), F.lit("")))
    number = r"(\d{1,2}(?:\.\d)?)"
    bare = F.coalesce(found(t, rf"^{number}(?:\s*(?:eu|it))?$"), found(t, rf"^(?:eu|it)\s*{number}$"))
    value = bare.try_cast("double")
    cm = found(t, r"(\d{2}(?:\.\d)?)\s*cm")
    plain = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    shoes = first_of([
        (cm.isNotNull(), _table(vocab.SHOE_CM, F.when(cm.contains("."), F.regexp_replace(cm, r"\.?0+$", "")).otherwise(F.regexp_replace(cm, "0+$", "")))),
        (t.rlike(rf"uk\s*{number}"), _table(vocab.SHOE_UK, found(t, rf"uk\s*{number}"))),
        (t.rlike(rf"(?:us|sz)\s*{number}"), _table(vocab.SHOE_US, found(t, rf"(?:us|sz)\s*{number}"))),
        (value.between(39, 48), plain),
        (value.between(6, 14), _table(vocab.SHOE_US, bare)),
    ])
    clothes = F.coalesce(
        F.upper(found(t, r"^(xxs|xs|s|m|l|xl|xxl)(?:\s*international)?$")),
        _table(vocab.CLOTHES_EU, found(t, r"(\d{2})\s*(?:fr|it|eu)?")),
        _table(vocab.CLOTHES_JP, found(t, r"^(?:jp\s*)?([0-5])$")),
    )
    return F.when(_c(size) != "", F.when(_c(category) == "footwear", shoes).otherwise(clothes))


def extract_season(title: ColumnOrName, tag: ColumnOrName) -> Column:
    """FW10, SS03 or 03SS to FW or SS and two digits; the tag goes before the title; AW is FW."""
    out = []
    for source in (_c(tag), _c(title)):
        s = F.coalesce(source, F.lit(""))
        for pattern, half, year in ((r"(?i)\b(fw|ss|aw)\s*(\d{2})\b", 1, 2), (r"(?i)\b(\d{2})\s*(ss|fw|aw)\b", 2, 1)):
            out.append(F.concat(F.replace(F.upper(found(s, pattern, half)), F.lit("AW"), F.lit("FW")), found(s, pattern, year)))
    return F.coalesce(*out)


def normalize_title(title: ColumnOrName, brand: ColumnOrName, word_boundary: bool = False) -> Column:
    """Product words: punctuation, brand aliases, noise tokens and short numbers removed.

    Aliases go as raw substrings, those of every brand where the brand is unknown; with word_boundary
    only as whole words.
    """
    text = F.regexp_replace(F.lower(_c(title)), "[^a-z0-9()é' ]", " ")
    for name, aliases in vocab.BRANDS.items():
        for a in aliases:
            # The alias stands in the plan once a step; where it does not apply a character that no text holds is searched.
            wanted = F.when(_c(brand).isNull() | (_c(brand) == name), F.lit(f" {a} " if word_boundary else a)).otherwise(F.lit("\u0001"))
            text = F.replace(F.concat(F.lit(" "), text, F.lit(" ")) if word_boundary else text, wanted, F.lit(" "))
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: (t != "") & ~t.isin(*vocab.NOISE) & ~t.rlike(r"^\d{1,2}(?:\.\d)?$"))
    return F.array_join(tokens, " ")


def model_line(brand: ColumnOrName, title_norm: ColumnOrName) -> Column:
    """Of each line of the brand the first alias in order counts; the longest of these wins, ties to the later name."""
    text = F.concat(F.lit(" "), _c(title_norm), F.lit(" "))
    branches = []
    for b, lines in vocab.MODEL_LINES.items():
        best = F.greatest(F.struct(F.lit(0).alias("n"), F.lit("").alias("line")), *(
            F.coalesce(first_of([(text.contains(f" {a} "), F.struct(F.lit(len(a)).alias("n"), F.lit(line).alias("line"))) for a in spec["aliases"]]), F.struct(F.lit(0).alias("n"), F.lit("").alias("line")))
            for line, spec in lines.items()
        ))
        branches.append((_c(brand) == b, null_if_empty(best["line"])))
    return first_of(branches)


def colorway(title_norm: ColumnOrName) -> Column:
    """The first two different colours of the title."""
    colours = F.array_distinct(F.filter(F.split(_c(title_norm), " "), lambda t: t.isin(*vocab.COLOURS)))
    return null_if_empty(F.array_join(F.slice(colours, 1, 2), "/"))


def colorway_tier(brand: ColumnOrName, line: ColumnOrName, colour: ColumnOrName) -> Column:
    """Strongest tier of the colour's parts: rare over core over standard; unknown without a colour."""
    tiers = {f"{b}|{m}|{c}": {"rare": 3, "core": 2}[t] for b, lines in vocab.TIERS.items() for m, cs in lines.items() for c, t in cs.items()}
    key = F.concat_ws("|", F.coalesce(_c(brand), F.lit("")), F.coalesce(_c(line), F.lit("")))
    known = F.create_map(*(F.lit(v) for kv in tiers.items() for v in kv))
    best = F.array_max(F.transform(F.split(_c(colour), "/"), lambda c: F.coalesce(F.try_element_at(known, F.concat(key, F.lit("|"), c)), F.lit(1))))
    return F.when(_c(colour).isNull(), "unknown").when(best == 3, "rare").when(best == 2, "core").otherwise("standard")


def season_year(season: ColumnOrName) -> Column:
    two = found(_c(season), r"(?i)^(?:fw|ss|aw)\s*(\d{2})\b").cast("int")
    return F.when(two < 90, two + 2000).otherwise(two + 1900)


def listing_year(season: ColumnOrName, title: ColumnOrName) -> Column:
    return F.coalesce(season_year(season), found(_c(title), r"\b(19[89]\d|20[0-3]\d)\b").cast("int"))


def era(brand: ColumnOrName, line: ColumnOrName, year: ColumnOrName) -> Column:
    """The first named era that holds the year, else the decade, else era-unknown."""
    named = [((_c(brand) == b) & (_c(line) == m) & _c(year).between(a, z), name) for b, lines in vocab.MODEL_LINES.items() for m, spec in lines.items() for name, a, z in spec["eras"]]
    decade = F.concat((F.floor(_c(year) / 10) * 10).cast("int").cast("string"), F.lit("s"))
    return F.coalesce(first_of(named), decade, F.lit("era-unknown"))


def is_archive_era(name: ColumnOrName, year: ColumnOrName, age: int = 5) -> Column:
    """archive-... is, recent-... is not; otherwise the first year in the name decides."""
    first = found(_c(name), r"(19[89]\d|20[0-3]\d)").cast("int")
    return F.coalesce(first_of([(_c(name).startswith("archive"), True), (_c(name).startswith("recent"), False), (first.isNotNull(), _c(year) - first >= age)]), F.lit(False))
