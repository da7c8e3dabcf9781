"""Vocabularies of the market domain."""

# Canonical brand and its aliases.
BRANDS = {
    "Rick Owens": ["rick owens", "rick owens drkshdw", "drkshdw", "ro"],
    "Balenciaga": ["balenciaga"],
    "Maison Margiela": ["maison margiela", "maison martin margiela", "margiela", "mmm"],
    "Enfant Riches Deprimes": ["enfant riches deprimes", "enfant riches déprimés", "erd"],
    "Number (N)ine": ["number (n)ine", "number nine", "number(n)ine", "number 9"],
    "Undercover": ["undercover", "undercoverism", "undercover jun takahashi"],
}

# Categories in order, with their keywords.
CATEGORIES = [
    ("footwear", ["sneaker", "sneakers", "trainer", "trainers", "shoe", "shoes", "boot", "boots", "high top", "geobasket", "geobaskets", "geo basket", "ramones", "gat", "gats", "german army", "dunk"]),
    ("outerwear", ["jacket", "bomber", "blouson", "coat", "parka", "anorak"]),
    ("knitwear", ["cardigan", "knit", "sweater", "jumper", "mohair"]),
    ("tops", ["hoodie", "tee", "t-shirt", "tshirt", "shirt", "sweatshirt", "top", "vest"]),
    ("bottoms", ["pants", "trousers", "jeans", "shorts", "cargos", "denim", "skirt"]),
]

# Condition scale in the order of the test, and letter grades.
CONDITIONS = [
    (5, ["new with tags", "never worn", "deadstock", "pristine", "new"]),
    (4, ["worn once", "used_excellent", "excellent", "very good"]),
    (2, ["used_fair", "fair", "creasing", "distressed by wear", "worn in"]),
    (1, ["poor", "damaged", "thrashed", "for repair"]),
    (3, ["gently used", "used_good", "good", "pre-owned", "used"]),
]
CONDITION_LETTERS = {"s": 5, "a": 4, "b": 3, "c": 2, "d": 1}

# Size tables.
SHOE_US = {"7": "40", "7.5": "40.5", "8": "41", "8.5": "41.5", "9": "42", "9.5": "42.5", "10": "43", "10.5": "43.5", "11": "44", "11.5": "44.5", "12": "45", "13": "46"}
SHOE_UK = {"6": "40", "7": "41", "8": "42", "9": "43", "10": "44", "11": "45", "12": "46"}
SHOE_CM = {"25.5": "40", "26": "41", "26.5": "42", "27": "42.5", "27.5": "43", "28": "44", "28.5": "45", "29": "46"}
CLOTHES_EU = {"44": "XS", "46": "S", "48": "M", "50": "L", "52": "XL", "54": "XXL"}
CLOTHES_JP = {"0": "XS", "1": "S", "2": "M", "3": "L", "4": "XL", "5": "XXL"}

# Words that say nothing about the product.
NOISE = "size sz mens men s us uk eu it jp fr cm authentic rare grail og new used".split()

# Model lines with aliases, category and eras (name, first year, last year).
MODEL_LINES = {
    "Rick Owens": {
        "Geobasket": {"aliases": ["geobasket", "geobaskets", "geo basket", "geo baskets"], "category": "footwear", "eras": [("og-2006-2012", 2006, 2012), ("mid-2013-2018", 2013, 2018), ("reissue-2019-plus", 2019, 2030)]},
        "Ramones": {"aliases": ["ramones"], "category": "footwear", "eras": [("early-2005-2012", 2005, 2012), ("drkshdw-era-2013-plus", 2013, 2030)]},
    },
    "Maison Margiela": {
        "GAT Replica": {"aliases": ["gat", "gats", "german army trainer", "german army trainers", "replica"], "category": "footwear", "eras": [("margiela-era-1999-2009", 1999, 2009), ("post-margiela-2010-plus", 2010, 2030)]},
        "Future High-Top": {"aliases": ["future", "future high top", "future hi", "future high-top"], "category": "footwear", "eras": [("first-gen-2009-2012", 2009, 2012), ("yeezus-era-2013-2014", 2013, 2014), ("later-2015-plus", 2015, 2030)]},
    },
    "Number (N)ine": {"Kurt Cardigan": {"aliases": ["kurt cardigan", "kurt cobain cardigan", "kurt"], "category": "knitwear", "eras": [("touch-me-ss03", 2003, 2003), ("reissues-2004-plus", 2004, 2030)]}},
    "Undercover": {"Scab": {"aliases": ["scab", "scab period", "scab blouson", "scab jacket"], "category": "outerwear", "eras": [("scab-ss03", 2003, 2003)]}},
    "Enfant Riches Deprimes": {"Assemblage Hoodie": {"aliases": ["assemblage hoodie", "assemblage"], "category": "tops", "eras": []}},
    "Balenciaga": {"Ghesquiere Runway Outerwear": {"aliases": ["ghesquiere bomber", "ghesquiere runway", "ghesquiere jacket", "ghesquiere"], "category": "outerwear", "eras": [("ghesquiere-1997-2012", 1997, 2012)]}},
}

# Colours, and the tiers of some lines' colours.
COLOURS = ["black", "white", "milk", "dust", "pearl", "chalk", "bone", "natural", "grey", "gray", "charcoal", "navy", "blue", "red", "oxblood", "burgundy", "green", "olive", "brown", "tan", "beige", "cream", "silver", "gold"]
TIERS = {
    "Rick Owens": {"Geobasket": {"black": "core", "milk": "core", "dust": "rare", "pearl": "rare"}, "Ramones": {"black": "core", "milk": "core"}},
    "Maison Margiela": {"GAT Replica": {"white": "core", "grey": "core", "gray": "core"}, "Future High-Top": {"black": "core", "white": "core", "gold": "rare", "silver": "rare"}},
}

# Figures and their aliases, in order.
FIGURES = {
    "Playboi Carti": ["playboi carti", "carti"],
    "Kanye West": ["kanye west", "kanye", "ye west"],
    "A$AP Rocky": ["asap rocky", "a$ap rocky"],
    "Travis Scott": ["travis scott", "la flame"],
    "Frank Ocean": ["frank ocean"],
    "Michele Lamy": ["michele lamy", "michèle lamy"],
    "Bella Hadid": ["bella hadid"],
    "Jerry Lorenzo": ["jerry lorenzo"],
}
