import pytest

from shelfgrade.constants import ALLERGENS, THEMES
from shelfgrade.functions import grades, numeric, text


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_title_case_follows_letters_not_words(spark):
    given = ["l'oréal", "3m", "b-c mcDonald", None, "ÉCLAIR au chocolat", ""]
    assert values(spark, text.title_case("v"), given) == ["L'Oréal", "3M", "B-C Mcdonald", None, "Éclair Au Chocolat", ""]
    assert values(spark, text.title_case("v"), given[:3]) == [g.title() for g in given[:3]]


def test_text_default_strips_all_white_space(spark):
    given = ["\t nestlé\n", " x ", None, "   "]
    assert values(spark, text.text_default("v", "Inconnu"), given) == ["nestlé", "x", "Inconnu", ""]
    assert values(spark, text.text_default("v", "Inconnu", title=True), given) == ["Nestlé", "X", "Inconnu", ""]


def test_grades_are_lowered_and_stripped(spark):
    assert values(spark, text.normalize_grade("v"), [" A ", "\tb\n", "unknown", None]) == ["a", "b", "unknown", None]
    assert values(spark, grades.grade_label("v"), ["a", "e", "x", None]) == [0, 4, None, None]
    assert values(spark, grades.label_grade(grades.grade_label("v")), ["b", "x"]) == ["b", None]
    assert values(spark, grades.grade_position("v"), ["a", "c", "e"]) == [0.0, 0.5, 1.0]
    assert values(spark, grades.describe_grade("v"), ["x", None]) == ["Inconnu", "Inconnu"]
    assert values(spark, grades.own_grade("v"), ["B", "x", None]) == ["b", "e", "e"]


def test_numbers(spark):
    given = ["1.5", " 2 ", "abc", "NaN", "1e3", "-4", None, "", "1d", "2.5f ", "inf", ".5", "n/a"]
    assert values(spark, numeric.number("v"), given) == [
        1.5, 2.0, None, None, 1000.0, -4.0, None, None, None, None, float("inf"), 0.5, None,
    ]
    assert values(spark, numeric.number("v", is_text=False), [1.0, float("nan"), None], "double") == [1.0, None, None]


def test_counts_drop_decimals_and_default_to_zero(spark):
    assert values(spark, numeric.count_or_zero("v"), ["3", "3.7", None, "x", "1.0", "-2.9"]) == [3, 3, 0, 0, 1, -2]


def test_clip_keeps_nulls(spark):
    given = [-1.0, 0.5, 9.0, None]
    assert values(spark, numeric.clip("v", 0.0, 3.0), given, "double") == [0.0, 0.5, 3.0, None]
    assert values(spark, numeric.clip("v", 0.0, None), given, "double") == [0.0, 0.5, 9.0, None]
    # A bound of zero clips to zero, and a bound under the lower limit leaves only that limit.
    assert values(spark, numeric.clip("v", 0.0, 0.0), given, "double") == [0.0, 0.0, 0.0, None]
    assert values(spark, numeric.clip("v", 0.0, -2.0), given, "double") == [0.0, 0.0, 0.0, None]


def test_relative_change(spark):
    rows = [(0.0, 5.0), (100.0, 101.9), (100.0, 102.0), (100.0, 50.0), (None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o double, n double")
    got = [r[0] for r in df.orderBy("i").select(numeric.relative_change("o", "n")).collect()]
    assert got == [None, None, 2.0, 50.0, None]


def test_terms_are_literal(spark):
    given = ["100% pur", "1000 pur", "a_b", "axb", "x.y", "it's", None]
    assert values(spark, text.contains("v", "100%"), given) == [True, False, False, False, False, False, None]
    assert values(spark, text.contains("v", "A_B"), given)[2:4] == [True, False]
    assert values(spark, text.contains_any("v", ["x.y", "'"]), given) == [False] * 4 + [True, True, False]


@pytest.mark.parametrize("group", list(ALLERGENS))
def test_every_keyword_of_a_group_counts(spark, group):
    given = [f"avec {w.upper()} dedans" for w in ALLERGENS[group]] + [None, "rien"]
    assert values(spark, text.contains_any("v", ALLERGENS[group]), given) == [True] * len(ALLERGENS[group]) + [False, False]


def test_query_words(spark):
    given = ["Est-ce que le Nutella, est bon?", "abc abcd", "????  !.!.x", "", None, "one twoo\tthree fourr fivee sixxx"]
    assert values(spark, text.query_words("v"), given) == [
        ["est-ce", "nutella", "bon"], ["abcd"], ["", "x"], [], None, ["twoo", "three", "fourr", "fivee"],
    ]


def test_first_declared_theme_wins(spark):
    given = ["le sel et le sucre", "du SEL", "rien du tout", None, "Nutri-Score et sel"]
    assert values(spark, text.first_matching("v", THEMES), given) == ["sugar", "salt", None, None, "grade"]


def test_corpus_keeps_one_blank_per_missing_column(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, "b", None)], "x string, y string, z string")
    assert sorted(r[0] for r in df.select(text.corpus_text(["x", "y", "z"])).collect()) == ["a  c", "b"]


def test_first_category(spark):
    assert values(spark, text.first_category("v"), [" Snacks , Sweet", "Dairy", "", None]) == ["Snacks", "Dairy", "", None]
