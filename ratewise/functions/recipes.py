"""Recipe text to structured features, as column expressions over the labelled text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, col, literal_array, strip

# Allergen words. A flag is set when a word occurs anywhere in the ingredients.
PEANUT_WORDS = ["peanut"]
TREE_NUT_WORDS = [
    "almond", "walnut", "pecan", "cashew", "pistachio", "hazelnut", "macadamia", "pine nut",
    "brazil nut",
]
DAIRY_WORDS = [
    "milk", "cheese", "cream", "butter", "yogurt", "sour cream", "buttermilk", "whey",
    "half and half", "condensed milk", "evaporated milk",
]
EGG_WORDS = ["egg", "eggs"]
WHEAT_WORDS = ["wheat", "flour", "bread", "pasta", "noodle", "breadcrumbs", "cracker"]
SOY_WORDS = ["soy", "soy sauce", "tofu", "edamame"]
FISH_WORDS = ["fish", "salmon", "tuna", "cod", "tilapia", "trout", "sardine"]
SHELLFISH_WORDS = ["shrimp", "prawn", "crab", "lobster", "clam", "mussel", "oyster", "scallop"]

# Words that count towards the protein score, one point each.
PROTEIN_WORDS = [
    "chicken breast", "chicken", "turkey", "tuna", "salmon", "shrimp", "prawn", "lean beef",
    "beef", "pork loin", "pork", "fish", "tofu", "tempeh", "lentil", "lentils", "beans",
    "black beans", "kidney beans", "chickpea", "chickpeas", "garbanzo", "edamame", "egg", "eggs",
    "greek yogurt", "cottage cheese",
]

# Calorie hints in ingredients and directions.
HIGH_CALORIE_WORDS = [
    "oil", "olive oil", "vegetable oil", "canola oil", "shortening", "lard", "butter",
    "margarine", "sugar", "brown sugar", "powdered sugar", "confectioners sugar", "corn syrup",
    "honey", "maple syrup", "chocolate", "chips", "cream", "heavy cream", "whipping cream",
    "sour cream", "cheese", "cream cheese", "condensed milk", "bacon", "sausage", "pepperoni",
    "mayonnaise",
]
LOW_CALORIE_WORDS = [
    "low calorie", "low-calorie", "low fat", "low-fat", "fat free", "fat-free", "light", "lite",
    "sugar-free", "sugar free", "skinless", "lean",
]
FRY_WORDS = ["fry", "fried", "deep fry", "deep-fry", "pan-fry"]
LIGHT_COOKING_WORDS = ["steam", "steamed", "grill", "grilled", "bake", "baked", "roast", "roasted"]

#: Flag column -> words. ``nuts`` and ``dairy`` themselves count as well.
ALLERGENS = {
    "has_peanut": PEANUT_WORDS,
    "has_tree_nuts": ["nuts"] + TREE_NUT_WORDS,
    "has_dairy": ["dairy"] + DAIRY_WORDS,
    "has_egg": EGG_WORDS,
    "has_wheat": WHEAT_WORDS,
    "has_soy": SOY_WORDS,
    "has_fish": FISH_WORDS,
    "has_shellfish": SHELLFISH_WORDS,
}

#: An avoid term on the left pulls in the words on the right.
AVOID_SYNONYMS = [
    (("milk", "dairy"), DAIRY_WORDS + ["dairy"]),
    (("nuts", "nut"), TREE_NUT_WORDS + ["nuts", "nut"]),
    (("peanut",), ["peanut", "peanuts"]),
]


def labelled_line(text: Column | str, label: str) -> Column:
    """Rest of the first line that starts with ``label:``, trimmed; empty when there is none."""
    return strip(
        F.regexp_extract(F.coalesce(col(text), F.lit("")), rf"(?im)^\s*{label}:(.*)$", 1)
    )


def ingredient_phrases(text: Column | str) -> Column:
    """Distinct, lower-cased ingredient phrases."""
    parts = F.split(labelled_line(text, "ingredients"), "[;；,，]+")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.lower(strip(p)), r"\s+", " "))
    return F.array_distinct(F.filter(clean, lambda p: F.length(p) > 0))


def directions_text(text: Column | str) -> Column:
    return labelled_line(text, "directions")


def time_minutes(text: Column | str) -> Column:
    """Rough cooking time: the upper end of a range, else first hours plus first minutes."""
    d = F.lower(directions_text(text))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(d, pattern, group).try_cast("int")

    upper = number(r"(\d+)\s*(?:-|to)\s*(\d+)\s*(?:minutes?|mins?)", 2)
    minutes = F.coalesce(number(r"(\d+)\s*(?:minutes?|mins?)", 1), F.lit(0))
    hours = F.coalesce(number(r"(\d+)\s*(?:hours?|hrs?|hr)\b", 1), F.lit(0))
    total = hours * 60 + minutes
    return F.when(upper.isNotNull(), upper).otherwise(F.when(total > 0, total)).cast("int")


def joined(ingredients: Column | str) -> Column:
    return F.lower(F.array_join(col(ingredients), " ; "))


def count_words(text: Column, words: list[str], match: str = "substring") -> Column:
    """How many of the words occur in the text.

    ``match='word'`` asks for whole words, so that "eggplant" no longer counts as "egg".
    """
    if match == "word":
        hit = lambda hay, w: F.regexp_like(hay, F.concat(F.lit(r"(?<![a-z])"), w, F.lit(r"(?![a-z])")))
    elif match == "substring":
        hit = lambda hay, w: F.contains(hay, w)
    else:
        raise ValueError("match must be 'substring' or 'word'")
    return bind(text, lambda hay: F.size(F.filter(literal_array(words), lambda w: hit(hay, w))))


def allergen_flags(ingredients: Column | str, match: str = "substring") -> list[Column]:
    text = joined(ingredients)
    return [(count_words(text, words, match) > 0).alias(name) for name, words in ALLERGENS.items()]


def protein_score(ingredients: Column | str, match: str = "substring") -> Column:
    text = joined(ingredients)
    bonus = F.when(F.contains(text, F.lit("protein")), F.lit(0.5)).otherwise(F.lit(0.0))
    return count_words(text, PROTEIN_WORDS, match).cast("double") + bonus


def high_calorie_penalty(ingredients, directions, match: str = "substring") -> Column:
    hits = F.least(count_words(joined(ingredients), HIGH_CALORIE_WORDS, match), F.lit(8))
    fried = count_words(F.lower(F.coalesce(col(directions), F.lit(""))), FRY_WORDS, match) > 0
    return hits.cast("double") + F.when(fried, F.lit(2.0)).otherwise(F.lit(0.0))


def low_calorie_score(ingredients, directions, match: str = "substring") -> Column:
    d = F.lower(F.coalesce(col(directions), F.lit("")))
    # a hint counts once, wherever it occurs; the separator keeps words from running together
    both = F.concat(joined(ingredients), F.lit("\n"), d)
    hints = F.least(count_words(both, LOW_CALORIE_WORDS, match), F.lit(4)).cast("double")
    light = F.when(count_words(d, LIGHT_COOKING_WORDS, match) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    raw = hints + light - high_calorie_penalty(ingredients, directions, match) * 0.5
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), raw))


def expand_avoid_terms(terms: Column | str, enable: bool = True) -> Column:
    """Lower-cased avoid terms, followed by the synonyms they pull in (each new one once)."""
    empty = F.array().cast("array<string>")
    cleaned = F.transform(F.coalesce(col(terms), empty), lambda t: F.lower(strip(t)))
    base = F.filter(cleaned, lambda t: F.length(t) > 0)
    if not enable:
        return base

    def expanded(asked: Column) -> Column:
        extra = F.concat(
            *[
                F.when(F.arrays_overlap(asked, literal_array(triggers)), literal_array(words)).otherwise(empty)
                for triggers, words in AVOID_SYNONYMS
            ]
        )
        return F.concat(asked, F.array_except(extra, asked))

    return bind(base, expanded)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two sets; 0 when either is empty."""
    left, right = col(a), col(b)
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)).cast("double") / F.greatest(union, F.lit(1))
    )


# Questionnaire answers and the English words used in the query.
GOALS = {"随便推荐": "", "减脂/低卡": "low calorie", "增肌/高蛋白": "high protein", "控糖/低碳": "low carb", "清淡/低盐": "low sodium"}
MEALS = {"不限": "", "早餐": "breakfast", "午餐": "lunch", "晚餐": "dinner", "加餐/零食": "snack"}
CUISINES = {
    "家常": "home cooking", "中式": "chinese", "川菜": "sichuan", "粤菜": "cantonese", "日式": "japanese",
    "韩式": "korean", "泰式": "thai", "西式": "western", "地中海": "mediterranean", "墨西哥": "mexican",
    "印度": "indian",
}
DIETS = {
    "素食": "vegetarian", "纯素": "vegan", "无麸质": "gluten-free", "无乳糖": "lactose-free",
    "不吃猪肉": "no pork", "不吃牛肉": "no beef", "清真": "halal",
}
GOAL_HIGH_PROTEIN = "增肌/高蛋白"
GOAL_LOW_CALORIE = "减脂/低卡"
DAILY_MEALS = ["早餐", "午餐", "晚餐"]
SNACK = "加餐/零食"


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Translate through a fixed table; unknown values pass unchanged."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, value), value)


def questionnaire_query(goal, meal, cuisines, dietary, must_include, avoid, max_time, extra) -> Column:
    """Query text of one questionnaire row; ``random`` when nothing was asked for."""

    def listed(label: str, values: Column | str, table: dict[str, str] | None = None) -> Column:
        items = col(values)
        if table:
            items = F.transform(items, lambda v: lookup(v, table))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", ")))

    def filled(value: Column) -> Column:
        return F.when(F.length(value) > 0, value)

    minutes = F.coalesce(col(max_time).cast("int"), F.lit(0))
    text = F.concat_ws(
        "; ",
        filled(lookup(F.coalesce(col(goal), F.lit("")), GOALS)),
        filled(lookup(F.coalesce(col(meal), F.lit("")), MEALS)),
        listed("cuisine", cuisines, CUISINES),
        listed("dietary", dietary, DIETS),
        F.when(minutes != 0, F.concat(F.lit("ready in "), minutes.cast("string"), F.lit(" minutes"))),
        listed("include", must_include),
        listed("avoid", avoid),
        filled(strip(F.coalesce(col(extra), F.lit("")))),
    )
    return F.when(F.length(text) > 0, text).otherwise(F.lit("random"))
