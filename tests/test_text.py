import pytest
from pyspark.sql import functions as F

from ratewise.functions import text as X
from test_recipes import one


def test_split_terms(spark):
    assert one(spark, X.split_terms("t"), t=" a，b, ;c；\n d ") == ["a", "b", "c", "d"]
    assert one(spark, X.split_terms(F.lit(None).cast("string"))) == []


def test_contains_any(spark):
    terms = F.array(F.lit("EGG"), F.lit("soy"))
    assert one(spark, X.contains_any("t", terms), t="Eggplant") is True
    assert one(spark, X.contains_any("t", F.array().cast("array<string>")), t="Eggplant") is False
    assert one(spark, X.contains_any(F.lit(None).cast("string"), terms)) is False


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('["a", " b ", "", null]', ["a", "b"]), ("", []), (None, []), ("not json", []), ('{"a": 1}', []),
        ('["1 c. \\"sugar\\"", 2]', ['1 c. "sugar"', "2"]), ('["broken', []),
    ],
)
def test_json_list(spark, raw, expected):
    assert one(spark, X.json_list(F.lit(raw).cast("string"))) == expected


def test_recipe_text(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    full = X.recipe_text(F.lit(" Pie "), arr(), arr("x", "y", "z"), arr("Mix. ", " ", "Bake.", "Eat."), True, 2, 3)
    assert one(spark, full) == "title: Pie\ningredients: x; y\ndirections: Mix. Bake."
    assert one(spark, X.recipe_text(F.lit(""), arr("n"), arr("x"), arr("s"), False)) == "ingredients: n"
    assert one(spark, X.recipe_text(F.lit(None).cast("string"), arr(), arr(), arr())) == ""


def test_item_id_and_previews(spark):
    assert one(spark, X.stable_item_id(F.lit(" l "), F.lit("t"))) == "l"
    assert one(spark, X.stable_item_id(F.lit(" "), F.lit("t"))) == one(spark, F.md5(F.lit("t")))
    assert one(spark, X.preview("t"), t="a\n" + "b" * 200) == "a " + "b" * 138 + "…"
    assert one(spark, X.summary("t"), t="  short ") == "short"


def test_tokens_and_ngrams(spark):
    tokens = X.tokens("t", X.ENGLISH_STOP_WORDS)
    assert one(spark, tokens, t="The Crème brûlée, a 2x of x_y!") == ["crème", "brûlée", "2x", "x_y"]
    grams = X.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 3)
    assert one(spark, grams) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, X.ngrams(F.array(F.lit("a")), 2)) == ["a"]


def test_keyword_overlap(spark):
    assert one(spark, X.keyword_overlap("q", "t"), q="egg, soy Salt", t="EGGS and salty") == pytest.approx(2 / 3)
    assert one(spark, X.keyword_overlap("q", "t"), q="?!", t="x") == 0.0


def test_names_and_labels(spark):
    assert one(spark, X.normalize_name("t"), t="  Half-Life®  2 ") == "halflife 2"
    row = spark.createDataFrame([("a", None, " ", 3)], "x string, y string, z string, n int")
    assert row.select(X.labelled_concat(["x", "y", "z", "n"]).alias("v")).first()["v"] == "x: a | n: 3"
