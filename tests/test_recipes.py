"""Hand-computed recipe features."""

import pytest
from pyspark.sql import functions as F

from ratewise.functions import recipes as R
from ratewise.functions import text as X
from ratewise.operators.recipes import recipe_metadata

NOODLES = (
    "title: Peanut Noodles\ningredients: Peanut Butter; noodles; soy sauce; Olive  Oil\n"
    "directions: Boil 10-15 minutes. Fry 5 minutes."
)
COD = "title: Steamed Cod\ningredients: cod; lemon; skinless chicken breast\ndirections: Steam 1 hour 20 minutes"
DOUGHNUTS = "title: Eggplant Doughnuts\ningredients: eggplant; doughnuts; coconut milk"


@pytest.fixture(scope="module")
def meta(spark):
    items = spark.createDataFrame([(1, NOODLES), (2, COD), (3, DOUGHNUTS), (4, None)], "item_id long, text string")
    return {r["item_id"]: r for r in recipe_metadata(items).collect()}


@pytest.mark.parametrize(
    "item, count, time, protein, low, penalty, flags",
    [
        ("1", 4, 15, 0.0, 0.0, 5.0, {"has_peanut", "has_dairy", "has_wheat", "has_soy"}),
        ("2", 3, 80, 2.0, 1.5, 0.0, {"has_fish"}),
        ("3", 3, None, 1.0, 0.0, 0.0, {"has_tree_nuts", "has_dairy", "has_egg"}),
        ("4", 0, None, 0.0, 0.0, 0.0, set()),
    ],
)
def test_metadata(meta, item, count, time, protein, low, penalty, flags):
    row = meta[item]
    assert (row["ingredients_count"], row["time_min"]) == (count, time)
    assert (row["protein_score"], row["low_calorie_score"], row["high_calorie_penalty"]) == (protein, low, penalty)
    assert {name for name in R.ALLERGENS if row[name]} == flags


def test_word_match_spares_eggplant(spark):
    items = spark.createDataFrame([(3, DOUGHNUTS)], "item_id long, text string")
    row = recipe_metadata(items, match="word").first()
    assert not row["has_egg"] and not row["has_tree_nuts"] and row["has_dairy"]


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_phrases_and_directions(spark):
    text = "x\n  INGREDIENTS:  A  b；a b,C\nIngredients: late\nDirections:  Mix. \n"
    assert one(spark, R.ingredient_phrases("t"), t=text) == ["a b", "c"]
    assert one(spark, R.directions_text("t"), t=text) == "Mix."
    assert one(spark, R.ingredient_phrases("t"), t="no list") == []


@pytest.mark.parametrize(
    "directions, minutes",
    [("Bake 10 to 12 mins", 12), ("cook 2 hrs", 120), ("wait 1 hour then 5 min", 65), ("0 minutes", None), ("", None)],
)
def test_time(spark, directions, minutes):
    assert one(spark, R.time_minutes("t"), t=f"directions: {directions}") == minutes
    assert one(spark, R.time_minutes("t"), t=directions) is None


def test_avoid_terms(spark):
    got = one(spark, R.expand_avoid_terms(F.array(F.lit(" Milk "))))
    assert got == [
        "milk", "cheese", "cream", "butter", "yogurt", "sour cream", "buttermilk", "whey", "half and half",
        "condensed milk", "evaporated milk", "dairy",
    ]
    assert one(spark, R.expand_avoid_terms(F.array(F.lit("Peanut")))) == ["peanut", "peanuts"]
    assert one(spark, R.expand_avoid_terms(F.array(F.lit("Milk")), enable=False)) == ["milk"]


def test_jaccard(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert one(spark, R.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, R.jaccard(a, F.array().cast("array<string>"))) == 0.0


def test_query_time_and_intent(spark):
    assert one(spark, X.query_time_limit("q"), q="Dinner UNDER 30 minutes") == 30
    assert one(spark, X.query_time_limit("q"), q="ready in 45 minutes") == 45
    assert one(spark, X.query_time_limit("q"), q="ready in 45 minutes, under 20 minute") == 20
    assert one(spark, X.query_time_limit("q"), q="fast") is None
    assert one(spark, X.wants_high_protein("q"), q="low protein") is False
    assert one(spark, X.wants_high_protein("q"), q="more protein") is True
    assert one(spark, X.wants_low_calorie("q"), q="a Low-Calorie one") is True


def test_questionnaire_query(spark):
    empty = F.array().cast("array<string>")
    nothing = R.questionnaire_query(F.lit("随便推荐"), F.lit("不限"), empty, empty, empty, empty, F.lit(0), F.lit("  "))
    assert one(spark, nothing) == "random"
    full = R.questionnaire_query(
        F.lit("增肌/高蛋白"), F.lit("晚餐"), F.array(F.lit("川菜"), F.lit("fusion")), F.array(F.lit("纯素")),
        F.array(F.lit("tofu")), F.array(F.lit("milk"), F.lit("egg")), F.lit(30), F.lit(" spicy "),
    )
    assert one(spark, full) == (
        "high protein; dinner; cuisine: sichuan, fusion; dietary: vegan; ready in 30 minutes; include: tofu; "
        "avoid: milk, egg; spicy"
    )
