"""Search, exclusion, look-up, preset SQL, substitutes and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.constants import ALLERGENS, COMPARED_SHAPE, FEATURES
from shelfgrade.operators import compare, search
from shelfgrade.operators.dedup import first_per_key
from shelfgrade.operators.substitutes import find_substitutes
from shelfgrade.plans import views
from shelfgrade.plans.sql import presets, run_preset, run_sql
from shelfgrade.plans.views import PRODUCTS, ROW
from shelfgrade.sources import gram_index, keyed, payloads
from shelfgrade.staging import scratch_path, stage

from .registry import ORDER, WITH_PRODUCTS, query, rounded

FRENCH_GROUPS = ["Gluten", "Oeufs", "Soja"]
# Groups of words that do occur in the texts.
TEXT_GROUPS = {"articles": ["le ", "une "], "und": ["und", "ich"], "ion": ["tion"]}


@query(
    "search_multi",
    WITH_PRODUCTS
    + f"SELECT {ORDER}, code, product_name, categories_en FROM products WHERE contains(lower(product_name), 'ring') AND contains(lower(categories_en), 'small')"
    + " AND nutriscore_grade = 'b' AND (ingredients_text IS NULL OR NOT contains(lower(ingredients_text), 'red'))"
    + f" ORDER BY {ORDER} LIMIT 100",
)
def search_multi(spark, folder):
    found = search.search(views.products(spark, folder), "RING", "Small", "B", ["Red"], 100, ROW)
    return found.select(*ROW, "code", "product_name", "categories_en")


@query("filter_contains", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), '%')")
def filter_contains(spark, folder):
    return search.search(views.table(spark, folder, "documents"), term="%", name="text", limit=None).select("doc_id", "lang")


@query("filter_category", WITH_PRODUCTS + f"SELECT {ORDER}, categories_en FROM products WHERE contains(categories_en, 'SMALL, r')")
def filter_category(spark, folder):
    return search.in_category(views.products(spark, folder).select(*ROW, "categories_en"), "SMALL, r")


@query(
    "exclude_terms",
    "WITH d AS (SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS text FROM documents) SELECT doc_id FROM d WHERE (text IS NULL OR NOT contains(lower(text), 'tion')) AND (text IS NULL OR NOT contains(lower(text), 'the '))",
)
def exclude_terms(spark, folder):
    documents = views.table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return search.exclude_terms(documents, ["Tion", "the "], "text").select("doc_id")


def _any(words):
    return " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)


@query(
    "exclude_allergen_groups",
    "SELECT doc_id FROM documents WHERE NOT (" + _any([w for g in FRENCH_GROUPS for w in ALLERGENS[g]]) + ") AND NOT ("
    + _any([*TEXT_GROUPS["und"], *TEXT_GROUPS["articles"]]) + ")",
)
def exclude_allergen_groups(spark, folder):
    documents = views.table(spark, folder, "documents")
    kept = search.exclude_groups(documents, FRENCH_GROUPS, "text")
    return search.exclude_groups(kept, ["und", "articles"], "text", TEXT_GROUPS).select("doc_id")


@query("lookup_key", WITH_PRODUCTS + f"SELECT {ORDER}, code, product_name FROM products WHERE code = '5-3' ORDER BY {ORDER} LIMIT 1")
def lookup_key(spark, folder):
    return search.lookup_key(views.products(spark, folder), "code", "5-3", ROW).select(*ROW, "code", "product_name")


LOOKED_UP = ["product_name", "brands", "energy_100g"]


@query(
    "lookup_batch",
    WITH_PRODUCTS
    + f", one AS (SELECT code, product_name, brands, energy_100g, additives_n FROM products QUALIFY row_number() OVER (PARTITION BY code ORDER BY {ORDER}) = 1)"
    + ", w AS (SELECT code FROM one UNION SELECT concat(o_orderkey, '-none') FROM orders)"
    + " SELECT w.code, product_name, brands, CASE WHEN additives_n >= 4 THEN coalesce(energy_100g, 0) ELSE energy_100g END AS energy_100g,"
    + " CASE WHEN additives_n < 4 THEN 'local' WHEN additives_n >= 4 THEN 'payload' END AS found_in FROM w LEFT JOIN one ON w.code = one.code",
)
def lookup_batch(spark, folder):
    one = first_per_key(views.products(spark, folder).select(*ROW, "code", *LOOKED_UP, "additives_n"), ["code"], ROW)
    one = stage(one.select("code", *LOOKED_UP, "additives_n")).frame
    local = one.where("additives_n < 4")
    # The other products are known only as responses of the product service.
    document = F.to_json(
        F.struct(
            F.lit(1).alias("status"),
            F.struct("product_name", "brands", F.struct("energy_100g").alias("nutriments")).alias("product"),
        )
    )
    responses = payloads.product_rows(one.where("additives_n >= 4").select("code", document.alias("payload")))
    wanted = one.select("code").unionByName(
        views.table(spark, folder, "orders").select(F.concat("o_orderkey", F.lit("-none")).alias("code"))
    )
    return search.lookup_many(wanted, local, responses, "code", LOOKED_UP)


# ---- preset SQL ----

PRESET_SQL = {
    "top_sugar": f"SELECT product_name, brands, nutriscore_grade, sugars_100g FROM products ORDER BY sugars_100g DESC NULLS LAST, {ORDER} LIMIT 10",
    "grade_dist": "SELECT nutriscore_grade, count(*) AS n FROM products GROUP BY nutriscore_grade",
    "no_additives": f"SELECT product_name, brands, energy_100g FROM products WHERE additives_n = 0 AND nutriscore_grade = 'a' ORDER BY {ORDER} LIMIT 20",
    "worst_brands": "SELECT brands, count(*) AS n_bad FROM products WHERE nutriscore_grade = 'e' GROUP BY brands ORDER BY n_bad DESC, brands LIMIT 10",
    "high_fiber": f"SELECT product_name, fiber_100g, nutriscore_grade FROM products WHERE fiber_100g > 5 ORDER BY fiber_100g DESC NULLS LAST, {ORDER} LIMIT 15",
}


def _preset(name):
    def run(spark, folder):
        return run_preset(views.products(spark, folder), presets()[name], ROW)

    query(f"sql_{name}", WITH_PRODUCTS + PRESET_SQL[name])(run)


for _name in PRESET_SQL:
    _preset(_name)


@query(
    "sql_presets",
    WITH_PRODUCTS + "SELECT nutriscore_grade, count(*) AS n, CAST(0 AS BIGINT) AS failed FROM products WHERE additives_n = 0 AND fiber_100g > 5 GROUP BY nutriscore_grade"
    " UNION ALL SELECT 'error' AS nutriscore_grade, CAST(0 AS BIGINT) AS n, CAST(2 AS BIGINT) AS failed",
)
def sql_presets(spark, folder):
    # A correct query, one that cannot be planned, and one that fails while it runs.
    products = views.products(spark, folder)
    good = run_sql(
        spark, "SELECT nutriscore_grade, count(*) AS n FROM {products} WHERE additives_n = :none AND fiber_100g > :least GROUP BY nutriscore_grade",
        {"none": 0, "least": 5.0}, products=products,
    )
    bad = run_sql(spark, "SELECT no_such_column FROM {products}", products=products)
    worse = run_sql(spark, "SELECT 1 / (l_linenumber - 1) AS x FROM {products}", products=products)
    failed = bad.unionByName(worse).agg(F.count("error").alias("failed")).select(F.lit("error").alias("nutriscore_grade"), F.lit(0).cast("long").alias("n"), "failed")
    return good.withColumn("failed", F.lit(0).cast("long")).unionByName(failed)


# ---- substitutes ----

CARRIED = ["code", "sugars_100g", "salt_100g"]

# Brute force: every distinct asking (category, name, grade) against all better rows.
ANSWERS = (
    WITH_PRODUCTS
    + ", ask AS (SELECT DISTINCT lower(trim(split_part(categories_en, ',', 1))) AS cat, product_name AS own, nutriscore_grade AS g FROM products WHERE categories_en IS NOT NULL AND nutriscore_grade > 'a')"
    + f", hits AS (SELECT ask.cat, ask.own, ask.g, p.*, row_number() OVER (PARTITION BY ask.cat, ask.own, ask.g ORDER BY p.nutriscore_grade, p.energy_100g NULLS LAST, {', '.join('p.' + c for c in ROW)}) AS position"
    + " FROM ask JOIN products p ON p.nutriscore_grade < ask.g AND contains(lower(p.categories_en), ask.cat) AND p.product_name <> ask.own"
    + " QUALIFY position <= 3)"
    + f", allhits AS (SELECT ask.g, p.*, row_number() OVER (PARTITION BY ask.g ORDER BY p.nutriscore_grade, p.energy_100g NULLS LAST, {', '.join('p.' + c for c in ROW)}) AS position"
    + " FROM (SELECT DISTINCT nutriscore_grade AS g FROM products WHERE nutriscore_grade > 'a') ask JOIN products p ON p.nutriscore_grade < ask.g QUALIFY position <= 3)"
)
SUB_OUT = "s.code AS sub_code, s.product_name AS sub_product_name, s.nutriscore_grade AS sub_nutriscore_grade, s.energy_100g AS sub_energy_100g"
ROW_P = ", ".join(f"p.{c}" for c in ROW)
ON_CATEGORY = "lower(trim(split_part(p.categories_en, ',', 1))) = s.cat AND p.product_name = s.own AND p.nutriscore_grade = s.g"
SHOWN = [*ROW, "position", "sub_code", "sub_product_name", "sub_nutriscore_grade", "sub_energy_100g"]


def _offers(spark, folder):
    return find_substitutes(views.products(spark, folder), ROW, payload=CARRIED)


@query("substitutes_topn", ANSWERS + f"SELECT {ROW_P}, CAST(s.position AS INTEGER) AS position, {SUB_OUT} FROM products p JOIN hits s ON {ON_CATEGORY}")
def substitutes_topn(spark, folder):
    return _offers(spark, folder).where("source = 'category'").select(*SHOWN)


@query(
    "substitutes_fallback",
    ANSWERS + f"SELECT {ROW_P}, CAST(s.position AS INTEGER) AS position, {SUB_OUT} FROM products p JOIN allhits s ON p.nutriscore_grade = s.g"
    + f" WHERE p.categories_en IS NULL OR NOT EXISTS (SELECT 1 FROM hits s WHERE {ON_CATEGORY})",
)
def substitutes_fallback(spark, folder):
    return _offers(spark, folder).where("source = 'overall'").select(*SHOWN)


PHRASE = "replace(categories_en, ', ', ' goods, ')"


@query(
    "substitutes_phrase",
    ANSWERS.replace(WITH_PRODUCTS, f"WITH base AS ({PRODUCTS}), products AS (SELECT * REPLACE ({PHRASE} AS categories_en) FROM base)\n")
    + f"SELECT {ROW_P}, CAST(s.position AS INTEGER) AS position, {SUB_OUT} FROM products p JOIN hits s ON {ON_CATEGORY}",
)
def substitutes_phrase(spark, folder):
    # First categories of two words.
    products = views.products(spark, folder).withColumn("categories_en", F.expr(PHRASE))
    return find_substitutes(products, ROW, payload=CARRIED).where("source = 'category'").select(*SHOWN)


def _delta(measure):
    o, n = f"coalesce(p.{measure}, 0)", f"coalesce(s.{measure}, 0)"
    return (
        f"SELECT {ROW_P}, CAST(s.position AS INTEGER) AS position, '{measure}' AS measure, {o} AS original, {n} AS substitute, abs(({n} - {o}) / {o} * 100) AS percent,"
        f" CASE WHEN {n} < {o} THEN 'down' ELSE 'up' END AS direction, {n} < {o} AS improves FROM products p JOIN hits s ON {ON_CATEGORY} WHERE {o} <> 0 AND abs(({n} - {o}) / {o} * 100) >= 2"
    )


@query(
    "substitute_deltas",
    ANSWERS + f"SELECT {ORDER}, position, measure, round(original, 6) AS original, round(substitute, 6) AS substitute, round(percent, 6) AS percent, direction, improves FROM ("
    + " UNION ALL ".join(_delta(m) for m in ("energy_100g", "sugars_100g", "salt_100g")) + ")",
)
def substitute_deltas(spark, folder):
    offers = _offers(spark, folder).where("source = 'category'")
    return rounded(compare.substitute_deltas(offers, [*ROW, "position"]), "original", "substitute", "percent")


# ---- pairs ----

PAIRS = (
    WITH_PRODUCTS
    + ", pairs AS (SELECT DISTINCT a.p_name AS name_1, b.p_name AS name_2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
    + f", one AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY {ORDER}) = 1)"
)


def _pairs(spark, folder):
    part = views.table(spark, folder, "part")
    left = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("name_1"))
    return left.join(part.select("p_partkey", F.col("p_name").alias("name_2")), "p_partkey").select("name_1", "name_2").distinct()


def _sides(columns, select):
    return " UNION ALL ".join(
        select.format(c=c, a=f"coalesce(a.{c}, 0)", b=f"coalesce(b.{c}, 0)")
        + " FROM pairs JOIN one a ON a.product_name = name_1 JOIN one b ON b.product_name = name_2"
        for c in columns
    )


@query(
    "compare_pairs",
    PAIRS + _sides(FEATURES, "SELECT name_1, name_2, '{c}' AS nutrient, CAST({a} AS DOUBLE) AS value_1, CAST({b} AS DOUBLE) AS value_2, CASE WHEN {a} < {b} THEN '1' WHEN {b} < {a} THEN '2' ELSE '=' END AS better"),
)
def compare_pairs(spark, folder):
    return compare.compare_pairs(_pairs(spark, folder), views.products(spark, folder), ROW)


@query(
    "compare_radar",
    PAIRS + _sides(COMPARED_SHAPE, "SELECT name_1, name_2, '{c}' AS nutrient, round({a} / greatest({a}, {b}, 1), 6) AS share_1, round({b} / greatest({a}, {b}, 1), 6) AS share_2"),
)
def compare_radar(spark, folder):
    return rounded(compare.pair_shapes(_pairs(spark, folder), views.products(spark, folder), ROW), "share_1", "share_2")


ASKED = ["5-3", "1-1", "0-0", "5-99", ""]


@query(
    "lookup_keyed",
    WITH_PRODUCTS
    + f"SELECT asked, count(code) AS n, true AS read_little FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in ASKED)}) AS v(asked) LEFT JOIN products ON code = asked GROUP BY asked",
)
def lookup_keyed(spark, folder):
    # Present and absent keys of a table written by key: under 5 % of its rows are read.
    products = views.products(spark, folder)
    path = scratch_path(spark, "keyed")
    keyed.write_keyed(products, path, "code", ROW, rows_per_group=100)
    rows = spark.read.parquet(path).count()
    answers = []
    for asked in ASKED:
        found = keyed.lookup_keys(spark, path, "code", [asked], products.schema)
        answers.append((asked, found.count(), keyed.rows_scanned(found) < 0.05 * rows))
    return spark.createDataFrame(answers, "asked string, n long, read_little boolean")


# Signs, capitals, accents, fewer than three characters, and a text that is nowhere.
SEARCHED = ["%", "TION", "é", "qu", "no such text", "200."]


@query(
    "search_indexed",
    "SELECT term, doc_id FROM documents, (VALUES " + ", ".join(f"('{t}')" for t in SEARCHED) + ") AS v(term) WHERE contains(lower(text), lower(term))",
)
def search_indexed(spark, folder):
    path = scratch_path(spark, "grams")
    gram_index.write_gram_index(views.table(spark, folder, "documents").select("doc_id", "text"), path, ["text"])
    found = None
    for term in SEARCHED:
        one = gram_index.find_containing(spark, path, {"text": term}).select(F.lit(term).alias("term"), "doc_id")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "search_indexed_columns",
    WITH_PRODUCTS
    + f"SELECT 'all' AS kind, {ORDER} FROM products WHERE contains(lower(product_name), 'ring') AND contains(lower(categories_en), 'small, r')"
    + f" UNION ALL SELECT 'any' AS kind, {ORDER} FROM products WHERE coalesce(contains(lower(product_name), 'lace'), false) OR coalesce(contains(lower(categories_en), 'promo b'), false)",
)
def search_indexed_columns(spark, folder):
    path = scratch_path(spark, "grams")
    columns = ["product_name", "categories_en"]
    gram_index.write_gram_index(views.products(spark, folder).select(*ROW, *columns), path, columns)
    both = gram_index.find_containing(spark, path, {"product_name": "RING", "categories_en": "Small, r"})
    either = gram_index.find_containing(spark, path, {"product_name": "lace", "categories_en": "Promo B"}, any_of=True)
    return both.select(F.lit("all").alias("kind"), *ROW).unionByName(either.select(F.lit("any").alias("kind"), *ROW))
