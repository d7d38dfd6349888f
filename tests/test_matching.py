import random

import pytest

from shelfgrade.operators import compare, messages, search
from shelfgrade.operators.substitutes import find_substitutes
from shelfgrade.operators.substring_join import join_containing, needle_table, text_table


def matches(spark, needles, texts):
    n = needle_table(spark.createDataFrame([(x,) for x in needles], "w string"), "w")
    t = text_table(spark.createDataFrame([(x,) for x in texts], "t string"), "t")
    return sorted((r["needle"], r["text"]) for r in join_containing(n, t).collect())


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(5)
    alphabet = "ab é.%_"
    texts = {"".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(150)} | {"line\nbreak abab"}
    needles = {"".join(rng.choices(alphabet, k=rng.randint(0, 5))) for _ in range(80)} | {"", "e\nb", "zzz", "abab"}
    want = sorted((n, t) for n in needles if n for t in texts if n in t)
    assert matches(spark, needles, texts) == want
    assert len({len(n) for n, _ in want}) >= 4


def test_substring_join_without_matches(spark):
    assert matches(spark, ["xyz", None], ["abc", None]) == []


PRODUCTS = "code string, product_name string, categories_en string, nutriscore_grade string, energy_100g double"


def brute_substitutes(rows, n):
    """What one look-up per product would answer."""
    order = lambda r: (r[3], r[4] is None, r[4] or 0.0, r[0])
    out = []
    for code, name, category, grade, _ in rows:
        own = grade.lower() if grade and grade.lower() in "abcde" else "e"
        better = sorted((r for r in rows if r[3] in tuple("abcde") and r[3] < own), key=order)
        asked = (category or "").split(",")[0].strip().lower()
        found = [r for r in better if asked and r[2] is not None and asked in r[2].lower() and r[1] is not None and r[1] != name][:n]
        source = "category" if found else "overall"
        for i, r in enumerate(found or better[:n]):
            out.append((code, i + 1, source, r[0]))
    return sorted(out)


@pytest.fixture
def no_broadcast(spark):
    """Sides too large to broadcast, as on a large table."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_substring_join_without_broadcast(spark, no_broadcast):
    assert matches(spark, ["ab", "b c", "abc", "x"], ["abc", "ab c", "x y"]) == [
        ("ab", "ab c"), ("ab", "abc"), ("abc", "abc"), ("b c", "ab c"), ("x", "x y"),
    ]


def test_substitutes_without_broadcast(spark, no_broadcast):
    test_substitutes_equal_one_lookup_per_product(spark, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_substitutes_equal_one_lookup_per_product(spark, seed):
    rng = random.Random(seed)
    categories = [None, "", "Snacks, Sweet", "snacks", "Dairy, Milk", "Milk", "Drinks, Milk drinks, Snacks", "Rare", "Sweet"]
    rows = [
        (
            f"{i:03d}", rng.choice([None, "x", "x", "x", "y", "z", "O'Neil"]), rng.choice(categories),
            rng.choice(["a", "b", "b", "c", "d", "e", "e", None, "unknown", "E"]), rng.choice([None, 1.0, 1.0, 2.0, 5.0]),
        )
        for i in range(120)
    ]
    products = spark.createDataFrame(rows, PRODUCTS)
    found = find_substitutes(products, ["code"], n=3).select("code", "position", "source", "sub_code")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
    got = found.collect()
    assert sorted(map(tuple, got)) == brute_substitutes(rows, 3)


def test_no_substitute_for_the_best_grade(spark):
    products = spark.createDataFrame([("1", "x", "c", "a", 1.0), ("2", "y", "c", "a", 2.0)], PRODUCTS)
    assert find_substitutes(products, ["code"]).isEmpty()


def test_deltas(spark):
    offers = spark.createDataFrame(
        [("1", 100.0, 50.0, 0.0, 3.0, 1.0, 1.05), ("2", 100.0, 101.0, None, 1.0, 2.0, 1.98)],
        "code string, energy_100g double, sub_energy_100g double, sugars_100g double, sub_sugars_100g double, salt_100g double, sub_salt_100g double",
    )
    got = {(r["code"], r["measure"]): (round(r["percent"], 6), r["direction"], r["improves"]) for r in compare.substitute_deltas(offers, ["code"]).collect()}
    assert got == {("1", "energy_100g"): (50.0, "down", True), ("1", "salt_100g"): (5.0, "up", False)}


def test_pairs_use_the_first_row_of_a_name(spark):
    products = spark.createDataFrame(
        [(1, "x", 5.0, None), (2, "x", 1.0, 1.0), (3, "y", 2.0, 0.25)], "at int, product_name string, energy_100g double, salt_100g double"
    )
    pairs = spark.createDataFrame([("x", "y"), ("y", "y")], "name_1 string, name_2 string")
    got = compare.compare_pairs(pairs, products, ["at"], ["energy_100g", "salt_100g"])
    assert sorted(map(tuple, got.collect())) == [
        ("x", "y", "energy_100g", 5.0, 2.0, "2"), ("x", "y", "salt_100g", 0.0, 0.25, "1"),
        ("y", "y", "energy_100g", 2.0, 2.0, "="), ("y", "y", "salt_100g", 0.25, 0.25, "="),
    ]
    shapes = compare.pair_shapes(pairs, products, ["at"], ["energy_100g", "salt_100g"])
    assert ("x", "y", "salt_100g", 0.0, 0.25) in [tuple(r) for r in shapes.collect()]


def test_search_criteria(spark):
    df = spark.createDataFrame(
        [("1", "50% Cacao", "Snacks", "b", None), ("2", "500 Cacao", "Snacks", "b", "milk"), ("3", "50% cacao", None, "b", "sugar"), ("4", "50% cacao", "snacks", "c", "")],
        "code string, product_name string, categories_en string, nutriscore_grade string, ingredients_text string",
    )
    codes = lambda found: sorted(r["code"] for r in found.collect())
    assert codes(search.search(df, "50%")) == ["1", "3", "4"]
    assert codes(search.search(df, "50%", "SNACK", "B")) == ["1"]
    assert codes(search.search(df, exclude=["Milk", "sugar"])) == ["1", "4"]
    assert codes(search.search(df, limit=2)) == ["1", "2"]
    assert codes(search.exclude_terms(df, ["", "milk"], "ingredients_text")) == ["1", "3", "4"]
    assert codes(search.exclude_terms(df, [""], "ingredients_text")) == ["1", "2", "3", "4"]
    assert codes(search.exclude_groups(df, ["Lactose"], "ingredients_text")) == ["1", "3", "4"]
    assert codes(search.any_column_contains(df, ["product_name", "categories_en"], "SNACK")) == ["1", "2", "4"]
    assert codes(search.lookup_key(df, "code", "3", ["code"])) == ["3"]


CATALOGUE = "code string, product_name string, brands string, nutriscore_grade string, energy_100g double, sugars_100g double, salt_100g double, fat_100g double, proteins_100g double, additives_n int"


def brute_products(message, rows):
    words = [w.strip("?.,!") for w in message.lower().split() if len(w) > 3][:4]
    found, seen = [], set()
    for word in words:
        hits = [r for r in rows if (r[1] is not None and word in r[1].lower()) or (r[2] is not None and word in r[2].lower())]
        for r in sorted(hits, key=lambda r: (r[3] is None, r[3] or "", r[0]))[:3]:
            if r[1] not in seen:
                seen.add(r[1])
                found.append(r[0])
    return found


def test_message_products_equal_one_lookup_per_word(spark):
    rng = random.Random(9)
    names = ["Chips salées", "Chips", "Soda", "Cola zero", None, "100% jus", "Gâteau chips", "Granola"]
    rows = [
        (f"{i:02d}", rng.choice(names), rng.choice(["Cola", "Chips", "Acme", None]), rng.choice(["a", "c", "e", None]), 1.0, 2.0, 3.0, 4.0, 5.0, 6)
        for i in range(40)
    ]
    texts = ["Que penses-tu des CHIPS?", "soda cola chips granola gâteau", "100%", "????", "abc de", "", "cola, cola!", "inconnu acme"]
    products = spark.createDataFrame(rows, CATALOGUE)
    asked = spark.createDataFrame(list(enumerate(texts)), "conv_id int, message string")
    found = messages.message_products(asked, products, ["code"]).select("conv_id", "position", "code").collect()
    got = {i: [r["code"] for r in sorted(found, key=lambda r: r["position"]) if r["conv_id"] == i] for i in range(len(texts))}
    assert got == {i: brute_products(t, rows) for i, t in enumerate(texts)}


def test_replies_and_context(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "du soda"), (1, 1, "assistant", "oui"), (2, 0, "user", "le sel"), (3, 0, "system", "x"), (4, 1, "user", "bonjour"), (4, 0, "user", "soda")],
        "conv_id int, turn int, role string, text string",
    )
    asked = messages.last_user_message(turns)
    assert {r["conv_id"]: r["message"] for r in asked.collect()} == {1: "du soda", 2: "le sel", 3: "", 4: "bonjour"}
    products = spark.createDataFrame(
        [("1", "Soda", None, "c", 2.5, 10.25, None, 0.5, 1.0, 3), ("2", "Eau", "Acme", "a", 0.0, 0.0, 0.0, 0.0, 0.0, 0), ("3", "Rien", "Acme", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0)],
        CATALOGUE,
    )
    found = messages.message_products(asked, products, ["code"])
    replies = {r["conv_id"]: tuple(r)[1:] for r in messages.reply_route(asked, found).collect()}
    assert replies == {
        1: ("products", None, "moderate", 1), 2: ("theme", "salt", None, 0), 3: ("generic", None, None, 0), 4: ("generic", None, None, 0),
    }
    blocks = {r["conv_id"]: r["context"] for r in messages.context_blocks(asked, found, products).collect()}
    assert blocks[2] == "CATALOGUE : 3 produits | Distribution : A:1 | C:1\n"
    assert blocks[1] == blocks[2] + (
        "\nPRODUITS TROUVÉS DANS LA BASE :\n"
        "  • Soda (Marque inconnue) — Nutri-Score C (Moyen — À consommer avec modération ⚠️)\n"
        f"    Énergie: {2.5:.0f} kcal | Sucres: {10.25:.1f}g | Sel: 0.00g | Graisses: 0.5g | Protéines: 1.0g | Additifs: 3\n"
    )


def test_tasks_keep_the_best_products_of_an_asked_word_before_the_shuffle(spark, monkeypatch):
    # Each product has words of its own that hold "berry", and all have some in common.
    rows = [(i, f"berry{i} blackberry{i % 7} berry x{i}", "abcde"[i * 7 % 5]) for i in range(200)]
    products = spark.createDataFrame([*rows, (1, *rows[1][1:])], "id int, product_name string, nutriscore_grade string").selectExpr("*", "'b' AS brands")
    asked = spark.createDataFrame([("berry",), ("x1",), ("ck",)], "word string")
    plans, real = [], messages.stage
    monkeypatch.setattr(messages, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    hits = messages.keyword_hits(asked, products, ["id"], shown=["product_name", "nutriscore_grade"])
    got = {(r["word"], r["place"]): r["id"] for r in hits.collect()}
    for (word,) in asked.collect():
        best = sorted((g, i) for i, name, g in rows if word in name)[:3]
        assert [got[word, p] for p in (1, 2, 3)] == [i for _, i in best]
    plan = dict(plans)["best"]
    assert any("WindowGroupLimit" in line and "dense_rank" in line and "Partial" in line for line in plan.splitlines())
