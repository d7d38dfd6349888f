"""Aggregates, top lists, samples, splits and evaluation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from shelfgrade.constants import FEATURES, GRADES
from shelfgrade.functions.grades import describe_grade
from shelfgrade.operators import evaluation, learning, sampling, statistics
from shelfgrade.plans import views
from shelfgrade.plans.views import ROW

from .registry import ORDER, WITH_PRODUCTS, WITH_RAW, query, rounded

# A grade that no row has counts zero in every report.
SIX = (*GRADES, "f")
GRADE_TABLE = "(VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f')) AS v(nutriscore_grade)"


@query(
    "dataset_summary",
    WITH_PRODUCTS + "SELECT count(*) AS n_products, count(DISTINCT brands) AS n_brands, count(DISTINCT categories_en) AS n_categories, round(avg(additives_n), 2) AS avg_additives, round(avg(sugars_100g), 2) AS avg_sugar, round(avg(salt_100g), 2) AS avg_salt FROM products",
)
def dataset_summary(spark, folder):
    return statistics.summary(views.products(spark, folder))


@query(
    "dataset_distributions",
    WITH_PRODUCTS + "SELECT 'nutriscore_grade' AS column_name, nutriscore_grade AS value, count(*) AS n FROM products GROUP BY nutriscore_grade"
    " UNION ALL SELECT 'nova_group' AS column_name, CAST(nova_group AS VARCHAR) AS value, count(*) AS n FROM products GROUP BY nova_group",
)
def dataset_distributions(spark, folder):
    return statistics.distributions(views.products(spark, folder), ["nutriscore_grade", "nova_group"])


@query("value_counts", WITH_RAW + "SELECT categories_en, count(*) AS n FROM raw WHERE categories_en IS NOT NULL GROUP BY categories_en")
def value_counts(spark, folder):
    return statistics.value_counts(views.raw_products(spark, folder), "categories_en")


@query(
    "dashboard_kpis",
    WITH_PRODUCTS + "SELECT count(*) AS n_products, round(100.0 * sum(CASE WHEN nutriscore_grade IN ('a', 'b') THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS pct_good,"
    " round(avg(sugars_100g), 6) AS avg_sugar, round(avg(additives_n), 6) AS avg_additives,"
    " round(least(avg(sugars_100g) / 50 * 100, 100), 6) AS sugar_progress, round(least(avg(additives_n) / 10 * 100, 100), 6) AS additives_progress FROM products",
)
def dashboard_kpis(spark, folder):
    return rounded(statistics.kpis(views.products(spark, folder)), "pct_good", "avg_sugar", "avg_additives", "sugar_progress", "additives_progress")


@query(
    "grade_dist_zero_fill",
    # No row has grade f.
    WITH_PRODUCTS + ", c AS (SELECT nutriscore_grade AS g, count(*) AS n FROM products GROUP BY nutriscore_grade)"
    + f" SELECT nutriscore_grade, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / greatest((SELECT sum(n) FROM c), 1), 6) AS percent FROM {GRADE_TABLE} LEFT JOIN c ON g = nutriscore_grade",
)
def grade_dist_zero_fill(spark, folder):
    return rounded(statistics.domain_counts(views.products(spark, folder), domain=SIX), "percent")


@query("top_bad_brands", WITH_PRODUCTS + "SELECT brands, count(*) AS n FROM products WHERE nutriscore_grade IN ('d', 'e') GROUP BY brands ORDER BY n DESC, brands LIMIT 15")
def top_bad_brands(spark, folder):
    return statistics.top_counts(views.products(spark, folder).where(F.col("nutriscore_grade").isin("d", "e")), "brands", 15)


@query(
    "avg_by_top_category",
    WITH_PRODUCTS + ", c AS (SELECT trim(split_part(categories_en, ',', 1)) AS category, avg(ascii(nutriscore_grade) - 97) AS m, count(*) AS n FROM products WHERE categories_en IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 10)"
    " SELECT category, round(m, 6) AS avg_label, n, CAST(row_number() OVER (ORDER BY m, category) AS INT) AS rank FROM c",
)
def avg_by_top_category(spark, folder):
    from shelfgrade.operators.cleaning import add_label

    return rounded(statistics.top_categories(add_label(views.products(spark, folder)), k=10), "avg_label")


def _cells():
    # corr() of a column with itself is 1; both orders of a pair have the same value.
    cells = [f"SELECT '{c}' AS column_1, '{c}' AS column_2, round(corr({c}, {c}), 2) AS correlation FROM p" for c in FEATURES]
    for a, b in combinations(FEATURES, 2):
        for x, y in ((a, b), (b, a)):
            cells.append(f"SELECT '{x}' AS column_1, '{y}' AS column_2, round(corr({b}, {a}), 2) AS correlation FROM p")
    return " UNION ALL ".join(cells)


@query("corr_matrix", WITH_PRODUCTS + ", p AS MATERIALIZED (SELECT * FROM products) " + _cells())
def corr_matrix(spark, folder):
    return statistics.correlations(views.products(spark, folder), FEATURES)


@query("corr_lower", WITH_PRODUCTS + ", p AS MATERIALIZED (SELECT * FROM products) " + " UNION ALL ".join(
    f"SELECT '{b}' AS column_1, '{a}' AS column_2, round(corr({b}, {a}), 2) AS correlation FROM p" for a, b in combinations(FEATURES, 2)
))
def corr_lower(spark, folder):
    return statistics.correlations(views.products(spark, folder), FEATURES, lower_triangle=True)


def _box(c):
    return (
        f"SELECT nutriscore_grade, '{c}' AS measure, round(CAST(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_low,"
        " round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,"
        " round(CAST(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_high"
        f" FROM (SELECT nutriscore_grade, CAST({c} AS DOUBLE) AS v FROM products) JOIN (SELECT nutriscore_grade AS g, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM products GROUP BY 1) ON g = nutriscore_grade GROUP BY nutriscore_grade"
    )


@query("box_stats", WITH_PRODUCTS + " UNION ALL ".join(_box(c) for c in FEATURES))
def box_stats(spark, folder):
    boxes = statistics.box_statistics(views.products(spark, folder), "nutriscore_grade", FEATURES)
    return rounded(boxes, "whisker_low", "q1", "median", "q3", "whisker_high")


def _describe(c):
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS \"count\", round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min,"
        f" round(quantile_cont({c}, 0.25), 2) AS q25, round(quantile_cont({c}, 0.5), 2) AS q50, round(quantile_cont({c}, 0.75), 2) AS q75, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM products"
    )


@query("describe_stats", WITH_PRODUCTS + " UNION ALL ".join(_describe(c) for c in FEATURES))
def describe_stats(spark, folder):
    return statistics.describe(views.products(spark, folder), FEATURES)


RAW_COLUMNS = (
    *ROW, "code", "product_name", "brands", "categories_en", "countries_en", "ingredients_text", "nutriscore_grade", *FEATURES,
)


@query("null_counts", WITH_RAW + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM raw" for c in RAW_COLUMNS) + ") WHERE n_null > 0")
def null_counts(spark, folder):
    return statistics.null_counts(views.raw_products(spark, folder))


# ---- top lists ----

def _top(short, measure):
    def run(spark, folder):
        return statistics.top_by(views.products(spark, folder), measure, ["product_name", "brands", "nutriscore_grade", measure], 10, ROW)

    query(
        f"topk_{short}",
        WITH_PRODUCTS + f"SELECT product_name, brands, nutriscore_grade, {measure} FROM products ORDER BY {measure} DESC NULLS LAST, {ORDER} LIMIT 10",
    )(run)


for _short, _measure in (("sugar", "sugars_100g"), ("salt", "salt_100g"), ("additives", "additives_n")):
    _top(_short, _measure)


@query(
    "distinct_first_category",
    "SELECT DISTINCT trim(split_part(text, ',', 1), ' \n\t\r') AS category FROM documents ORDER BY category LIMIT 80",
)
def distinct_first_category(spark, folder):
    return statistics.distinct_categories(views.table(spark, folder, "documents"), "text")


@query("grade_describe", WITH_RAW + f"SELECT {ORDER}, CASE nutriscore_grade WHEN 'a' THEN 'Excellent — Très sain ✅' WHEN 'b' THEN 'Bon — Bonne qualité nutritionnelle 👍' WHEN 'c' THEN 'Moyen — À consommer avec modération ⚠️' WHEN 'd' THEN 'Médiocre — Qualité nutritionnelle faible 👎' WHEN 'e' THEN 'Mauvais — À éviter ❌' ELSE 'Inconnu' END AS description FROM raw")
def grade_describe(spark, folder):
    return views.raw_products(spark, folder).select(*ROW, describe_grade("nutriscore_grade").alias("description"))


# ---- samples and splits ----

ROW_ID = "concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', l_quantity)"


def _identified(spark, folder, *columns):
    return views.products(spark, folder).select(F.expr(ROW_ID).alias("row_id"), *columns)


@query("sample_exact_n", WITH_PRODUCTS + f"SELECT {ROW_ID} AS row_id, nutriscore_grade FROM products ORDER BY md5(concat('42', {ROW_ID})) LIMIT 30000")
def sample_exact_n(spark, folder):
    return sampling.sample_rows(_identified(spark, folder, "nutriscore_grade"), 30_000, "row_id")


@query("sample_best_grade", WITH_PRODUCTS + f"SELECT {ROW_ID} AS row_id, product_name FROM products WHERE nutriscore_grade = 'a' ORDER BY md5(concat('7', {ROW_ID})) LIMIT 3")
def sample_best_grade(spark, folder):
    best = _identified(spark, folder, "product_name", "nutriscore_grade").where("nutriscore_grade = 'a'")
    return sampling.sample_rows(best, 3, "row_id", seed=7).select("row_id", "product_name")


@query(
    "stratified_split",
    WITH_PRODUCTS + f"SELECT {ROW_ID} AS row_id, nutriscore_grade, row_number() OVER (PARTITION BY nutriscore_grade ORDER BY md5(concat('42', {ROW_ID}))) <= floor(0.2 * count(*) OVER (PARTITION BY nutriscore_grade) + 0.5) AS is_test FROM products",
)
def stratified_split(spark, folder):
    return sampling.stratified_split(_identified(spark, folder, "nutriscore_grade"), "nutriscore_grade", "row_id")


@query(
    "plain_split",
    WITH_PRODUCTS + f"SELECT {ROW_ID} AS row_id, CAST(concat('0x', substr(md5(concat('42', {ROW_ID})), 1, 13)) AS BIGINT) < CAST(trunc(0.2 * 4503599627370496) AS BIGINT) AS is_test FROM products",
)
def plain_split(spark, folder):
    return sampling.plain_split(_identified(spark, folder), "row_id")


@query(
    "standardize",
    WITH_PRODUCTS + f", s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM products) SELECT {ORDER}, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES) + " FROM products, s",
)
def standardize(spark, folder):
    return rounded(learning.standardize(views.products(spark, folder).select(*ROW, *FEATURES), FEATURES), *FEATURES)


@query(
    "ml_features",
    WITH_PRODUCTS + f"SELECT {ORDER}, CAST(ascii(nutriscore_grade) - 97 AS INTEGER) AS nutriscore_label, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in FEATURES) + " FROM products",
)
def ml_features(spark, folder):
    from pyspark.ml.functions import vector_to_array

    from shelfgrade.operators.cleaning import add_label

    rows = learning.feature_rows(add_label(views.products(spark, folder)), keep=ROW)
    values = vector_to_array("features")
    return rows.select(*ROW, "nutriscore_label", *[values[i].alias(c) for i, c in enumerate(FEATURES)])


# ---- evaluation of a fixed rule that guesses the grade ----

GUESS = "CASE WHEN additives_n < 2 THEN nutriscore_grade WHEN fat_100g < 20 THEN 'b' WHEN fat_100g < 45 THEN 'd' ELSE 'a' END"
COUNTED = (
    WITH_PRODUCTS + f", g AS (SELECT nutriscore_grade AS a, {GUESS} AS p FROM products)"
    + ", d AS (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS x)"
    + ", m AS (SELECT d1.x AS actual, d2.x AS predicted, (SELECT count(*) FROM g WHERE a = d1.x AND p = d2.x) AS n FROM d d1, d d2)"
)


def _guessed(spark, folder):
    return views.products(spark, folder).select("nutriscore_grade", F.expr(GUESS).alias("guess"))


@query(
    "confusion_matrix",
    COUNTED + " SELECT actual, predicted, n, CASE WHEN sum(n) OVER (PARTITION BY actual) > 0 THEN round(n * 100.0 / sum(n) OVER (PARTITION BY actual), 6) ELSE 0.0 END::DOUBLE AS percent FROM m",
)
def confusion_matrix(spark, folder):
    return rounded(evaluation.confusion_matrix(_guessed(spark, folder), "nutriscore_grade", "guess", SIX), "percent")


@query(
    "classification_report",
    COUNTED
    + ", c AS (SELECT x AS class, (SELECT sum(n) FROM m WHERE actual = x AND predicted = x) AS tp, (SELECT sum(n) FROM m WHERE actual = x) AS support, (SELECT sum(n) FROM m WHERE predicted = x) AS guessed FROM d)"
    + ", s AS (SELECT class, support, tp, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM c)"
    + ", f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM s)"
    + ", r AS (SELECT class, pr AS precision, rc AS recall, f1 AS f1_score, support FROM f"
    + " UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f"
    + " UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1), sum(support) FROM f"
    + " UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(rc * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)"
    + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM r",
)
def classification_report(spark, folder):
    matrix = evaluation.confusion_matrix(_guessed(spark, folder), "nutriscore_grade", "guess", SIX)
    return rounded(evaluation.classification_report(matrix), "precision", "recall", "f1_score")


# ---- recorded runs ----

def _metrics(name, table):
    return (
        f"SELECT '{name}' AS model, round(CAST(round(sum(CASE WHEN a = p THEN 1 ELSE 0 END) / count(*), 4) AS DOUBLE) * 100, 6) AS accuracy_pct,"
        f" (SELECT round(sum(2.0 * tp / (guessed + support) * support) / sum(support), 4) FROM (SELECT x, (SELECT count(*) FROM {table} WHERE a = x AND p = x) AS tp,"
        f" (SELECT count(*) FROM {table} WHERE p = x) AS guessed, (SELECT count(*) FROM {table} WHERE a = x) AS support FROM d) WHERE guessed + support > 0) AS f1_score FROM {table}"
    )


@query(
    "run_metrics",
    WITH_PRODUCTS + f", d AS (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS x), g AS (SELECT nutriscore_grade AS a, {GUESS} AS p FROM products), h AS (SELECT nutriscore_grade AS a, 'b' AS p FROM products) "
    + _metrics("rule", "g") + " UNION ALL " + _metrics("constant", "h"),
)
def run_metrics(spark, folder):
    from shelfgrade.sources.sinks import append_metrics
    from shelfgrade.staging import scratch_path

    rows = views.products(spark, folder).select("nutriscore_grade", F.expr(GUESS).alias("rule"), F.lit("b").alias("constant"))
    path = scratch_path(spark, "metrics")
    # The later run of a model replaces the earlier one in the comparison.
    append_metrics(spark, path, "rule", 0.0, 0.0)
    for model in ("rule", "constant"):
        scores = evaluation.metrics(evaluation.confusion_matrix(rows, "nutriscore_grade", model))
        append_metrics(spark, path, model, scores["accuracy"], scores["f1_score"])
    return rounded(evaluation.compare_models(spark.read.parquet(path)), "accuracy_pct", "f1_score")
