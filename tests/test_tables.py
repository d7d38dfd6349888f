import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgrade.operators import boosting, evaluation, learning, registry, statistics
from shelfgrade.plans.sql import run_sql
from shelfgrade.schema import rename_coalesce, select_available
from shelfgrade.sources import files, payloads, sinks
from shelfgrade.streaming import sinks as stream_sinks
from shelfgrade.streaming import sources as stream_sources


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


# ---- registry ----

def greedy(new, taken_names, taken_mails):
    names, mails, kept = set(taken_names), set(taken_mails), []
    for at, name, mail in new:
        if (name is not None and name in names) or (mail is not None and mail in mails):
            continue
        kept.append(at)
        names.add(name)
        mails.add(mail)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_on_either_key_equals_taking_rows_in_order(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, n: rng.choice([None, "hot", "hot", *[f"{p}{i}" for i in range(n)]])
    new = [(i, pick("u", 12), pick("m", 12)) for i in range(60)]
    old = [(100, "u1", "m2"), (103, "u5", None)]
    schema = "at int, name string, mail string"
    added = registry.append_unique_any(
        spark.createDataFrame(new, schema), spark.createDataFrame(old, "id int, name string, mail string"), ["name", "mail"], ["at"]
    ).orderBy("id").collect()
    assert [r["at"] for r in added] == greedy(new, ["u1", "u5"], ["m2"])
    assert [r["id"] for r in added] == list(range(104, 104 + len(added)))


def test_append_if_absent(spark):
    schema = "at int, user_id int, product_code string, substitute_code string"
    old = spark.createDataFrame([(7, 1, "p", "s")], "id int, user_id int, product_code string, substitute_code string")
    new = spark.createDataFrame([(3, 1, "p", "s"), (2, 1, "p", "t"), (1, 1, "p", "t"), (5, 2, "p", "s")], schema)
    added = registry.append_if_absent(new, old, ["user_id", "product_code", "substitute_code"], ["at"])
    assert sorted((r["id"], r["at"]) for r in added.collect()) == [(8, 1), (9, 5)]
    assert registry.next_id(old.limit(0)) == 1


def test_row_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = registry.number_rows(df, ["k"], 10).collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(10 + i, i) for i in range(1000)]


def test_history_delete_and_counts(spark):
    table = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 1, "2024-03-01"), (3, 2, "2024-02-01")], "id int, user_id int, saved_at string")
    assert [r["id"] for r in registry.history(table, 1).collect()] == [2, 1]
    doomed = spark.createDataFrame([(1, 1), (3, 1)], "id int, user_id int")
    assert sorted(r["id"] for r in registry.delete_keys(table, doomed, ["id", "user_id"]).collect()) == [2, 3]
    assert registry.table_sizes({"a": table, "b": table.limit(0)}).first().asDict() == {"a": 3, "b": 0}
    assert statistics.table_count(spark, "no_such_table") == 0


# ---- sources and sinks ----

def test_dump_scan(spark, folder):
    with open(f"{folder}/dump.tsv", "w") as f:
        f.write("code\tproduct_name\textra\tsaturated-fat_100g\n0012\tÉclair\tx\t1.5\n13\ttoo\tmany\t2\tfields\there\n14\tBon\ty\t\n15\tCourt\n")
    df = files.scan_delimited(spark, f"{folder}/dump.tsv")
    assert df.columns == ["code", "product_name", "saturated_fat_100g"]
    assert [tuple(r) for r in df.orderBy("code").collect()] == [("0012", "Éclair", "1.5"), ("14", "Bon", None), ("15", "Court", None)]
    whole = files.scan_delimited(spark, f"{folder}/dump.tsv", wanted=None)
    assert whole.columns == ["code", "product_name", "extra", "saturated_fat_100g"] and len(whole.collect()) == 3
    ordered = files.with_ingest_order(df)
    assert ordered.select("ingest_file", "ingest_block", "ingest_row").count() == 3


def test_region_dump_prefers_kilocalories(spark, folder):
    with open(f"{folder}/region.tsv", "w") as f:
        f.write("code\tenergy-kcal_100g\tenergy_100g\n1\t5\t20\n2\t\t40\n")
    df = files.scan_region(spark, f"{folder}/region.tsv")
    assert [tuple(r) for r in df.orderBy("code").collect()] == [("1", "5"), ("2", "40")]


def test_compressed_dump_scan(spark, folder):
    import gzip

    with gzip.open(f"{folder}/dump.tsv.gz", "wt") as f:
        f.write("code\tproduct_name\n1\ta\n")
    assert files.scan_delimited(spark, f"{folder}/dump.tsv.gz").first()["product_name"] == "a"


def test_rename_many_to_one(spark):
    df = spark.createDataFrame([("1", None, "9"), ("2", "5", "9"), ("3", "4", None)], "code string, `energy-kcal_100g` string, energy_100g string")
    out = rename_coalesce(df, {"energy_100g": ("energy-kcal_100g", "energy_100g")})
    assert out.columns == ["code", "energy_100g"]
    assert [r[1] for r in out.orderBy("code").collect()] == ["9", "5", "4"]
    assert select_available(out, ["x", "energy_100g"]).columns == ["energy_100g"]


def test_csv_round_trip(spark, folder):
    rows = [("007", 'a "quoted", name', 1.5, 2), ("008", None, None, None)]
    df = spark.createDataFrame(rows, "code string, product_name string, energy_100g double, additives_n int")
    sinks.write_csv(df, f"{folder}/out", single_file=True)
    back = files.scan_clean(spark, f"{folder}/out")
    assert back.dtypes == df.dtypes
    assert [tuple(r) for r in back.orderBy("code").collect()] == rows
    # The raw file is written and read with the same separator.
    sinks.write_csv(df, f"{folder}/tabs", sep="\t")
    assert files.scan_delimited(spark, f"{folder}/tabs", sep="\t").count() == 2


def test_first_available_source(spark, folder):
    spark.range(3).write.parquet(f"{folder}/b")
    read = lambda s, p: s.read.parquet(p)
    name, df = files.first_available(spark, [("clean", f"{folder}/a", read), ("dump", f"{folder}/b", read)])
    assert (name, df.count()) == ("dump", 3)
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [("clean", f"{folder}/a", read)])


def test_payloads(spark):
    texts = [
        '{"status": 0, "product": {"product_name": "no"}}',
        '{"status": 1, "product": {}}',
        '{"status": 1, "product": {"product_name": "x", "nutriscore_grade": "A", "nutriments": {"energy-kcal_100g": 0, "energy_100g": 7}}}',
        '{"status": 1, "product": {"product_name": "y", "nutriscore_grade": "unknown"}}',
        "not json",
    ]
    documents = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = {r["product_name"]: (r["nutriscore_grade"], r["energy_100g"], r["salt_100g"]) for r in payloads.product_rows(documents).collect()}
    assert got == {"x": ("a", 7.0, 0.0), "y": ("?", 0.0, 0.0)}
    pages = spark.createDataFrame([('{"products": [{"code": "1"}, {"code": "2", "salt_100g": "1"}]}',), ('{"products": []}',)], "payload string")
    assert sorted(r["code"] for r in payloads.search_rows(pages).collect()) == ["1", "2"]


def test_messages_write_nulls(spark):
    df = spark.createDataFrame([("é", float("nan"), None)], "code string, v double, w int")
    assert json.loads(payloads.to_messages(df).first()["value"]) == {"code": "é", "v": None, "w": None}
    assert "é" in payloads.to_messages(df).first()["value"]


def test_jdbc_rows_and_metrics(spark, folder):
    df = spark.createDataFrame([("1", 2.0, "x")], "code string, `saturated-fat_100g` double, extra string")
    rows = sinks.jdbc_rows(df, ["code", "saturated_fat_100g", "salt_100g"], {"saturated_fat_100g": ("saturated-fat_100g",)})
    assert rows.columns == ["code", "saturated_fat_100g"]
    path = f"{folder}/metrics"
    sinks.append_metrics(spark, path, "trees", 0.123456, 0.5)
    sinks.append_metrics(spark, path, "trees", 0.98765432, 0.9, n_samples=10)
    sinks.append_metrics(spark, path, "text", 0.7, 0.69, encoder="hash")
    runs = spark.read.parquet(path)
    assert sinks.part_files(spark, path) == 3
    best = {r["model"]: (round(r["accuracy_pct"], 4), r["f1_score"]) for r in evaluation.compare_models(runs).collect()}
    assert best == {"trees": (98.77, 0.9), "text": (70.0, 0.69)}


def test_replace_table_counts(spark, folder):
    assert sinks.replace_table(spark.range(5), "some_products", f"{folder}/t1") == 5
    assert sinks.replace_table(spark.range(2), "some_products", f"{folder}/t1") == 2
    assert spark.table("some_products").count() == 2 == statistics.table_count(spark, "some_products")
    spark.sql("DROP TABLE some_products")


def test_faulty_sql_answers_with_an_error_row(spark):
    df = spark.range(3)
    assert run_sql(spark, "SELECT count(*) AS n FROM {products} WHERE id > :least", {"least": 0}, products=df).first()["n"] == 2
    for bad in ("SELECT nope FROM {products}", "SELEC 1", "SELECT 1 / (id - 1) AS x FROM {products}"):
        assert run_sql(spark, bad, products=df).columns == ["error"]
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary]


# ---- evaluation and models ----

def test_report_with_absent_classes(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] * 2
    df = spark.createDataFrame(pairs, "y string, p string")
    matrix = evaluation.confusion_matrix(df, "y", "p")
    assert matrix.count() == 25
    report = {r["class"]: r for r in evaluation.classification_report(matrix).collect()}
    assert report["a"]["precision"] == pytest.approx(3 / 5) and report["a"]["recall"] == pytest.approx(3 / 4)
    assert report["c"]["precision"] == 0.0 and report["e"]["support"] == 0
    assert report["accuracy"]["f1_score"] == pytest.approx(5 / 8)
    scores = evaluation.metrics(matrix)
    weighted = (4 * (2 * 0.6 * 0.75 / 1.35) + 2 * (2 * (2 / 3) / (5 / 3))) / 8
    assert scores["f1_score"] == pytest.approx(weighted)


def test_boosted_model_is_saved_and_scores_missing_features_as_zero(spark, folder):
    rows = [(float(i % 5), float(i % 3), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "sugars_100g double, salt_100g double, nutriscore_label int")
    model = learning.train_boosted(df, max_iter=8, max_depth=3)
    scored = learning.score_boosted(model, df.withColumn("grade", F.substring(F.lit("abcde"), 1, 1)))
    wrong = scored.where("substr('abcde', nutriscore_label + 1, 1) <> predicted_nutriscore").count()
    assert wrong == 0
    learning.save_model(model, f"{folder}/model")
    again = learning.load_model(spark, f"{folder}/model")
    one = learning.score_boosted(again, spark.createDataFrame([(1.0,)], "salt_100g double")).first()
    assert one["predicted_nutriscore"] == "a"
    top = learning.feature_importance(again).first()
    assert top["feature"] == "sugars_100g"
    with pytest.raises(FileNotFoundError):
        learning.load_model(spark, f"{folder}/none")


def test_boosting_beats_a_forest_and_one_guess(spark):
    """Five classes by the sum of two features and the sign of a third: no single cut tells them."""
    rng = np.random.default_rng(3)
    x = rng.random((2500, 4))
    label = np.clip(((x[:, 0] + x[:, 1]) * 2.5).astype(int) + (x[:, 2] > 0.5) - 1, 0, 4)
    rows = [(i, *map(float, v), int(y)) for i, (v, y) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, noise double, nutriscore_label int")
    test, columns = df.where("id % 5 = 0"), ["a", "b", "c", "noise"]
    right = {}
    for train in (learning.train_boosted, learning.train_forest):
        model = train(df.where("id % 5 <> 0"), columns, max_iter=40)
        scored = learning.score_boosted(model, test, "grade")
        right[train.__name__] = scored.where("grade = substr('abcde', nutriscore_label + 1, 1)").count() / 500
        if train is learning.train_boosted:
            order = [r["feature"] for r in learning.feature_importance(model).collect()]
            assert order[-1] == "noise"
    assert right["train_boosted"] > 0.85 and right["train_boosted"] > right["train_forest"]


def test_trees_follow_gradients_and_the_order_of_rows_does_not_matter():
    rng = np.random.default_rng(4)
    x, y = rng.random((600, 3)), rng.integers(0, 3, 600)
    y[x[:, 1] > 0.5] = 2
    edges = [np.quantile(x[:, f], np.arange(1, 16) / 16) for f in range(3)]
    loss = []
    for rounds in (1, 5, 25):
        trees = list(boosting.boost(x, y, edges, 3, rounds, 3, 0.3, 1.0, 1.0, 7))
        arrays = [np.array([t[k] for t in trees]) for k in range(2, 6)]
        model = boosting.BoostedTrees(["a", "b", "c"], 3, np.array([t[1] for t in trees]), *arrays)
        margins = model.margins(x)
        loss.append(float((np.log(np.exp(margins).sum(axis=1)) - margins[np.arange(600), y]).mean()))
    assert np.log(3) > loss[0] > loss[1] > loss[2]
    mixed = rng.permutation(600)
    again = list(boosting.boost(x[mixed], y[mixed], edges, 3, 25, 3, 0.3, 1.0, 1.0, 7))
    assert all(np.allclose(a[k], b[k]) for a, b in zip(trees, again) for k in range(2, 6))
    # The root of the first tree cuts where a plain search over all cuts finds the largest gain.
    g, h = 1 / 3 - (y == 0), np.full(600, 4 / 9)

    def gain(f, cut):
        left = x[:, f] <= cut
        parts = ((g[m].sum(), h[m].sum()) for m in (left, ~left))
        return sum(a * a / (b + 1) for a, b in parts) - g.sum() ** 2 / (h.sum() + 1)

    best = max(((gain(f, c), f, c) for f in range(3) for c in edges[f]))
    assert (trees[0][2][0], trees[0][3][0]) == best[1:] and np.isclose(trees[0][4][0], best[0])


def test_encoder_is_called_per_batch_and_logistic_scores(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0 if "a" in t else -1.0] for t in texts]

    df = spark.createDataFrame([(i, "abc" if i % 2 else "xyz", i % 2) for i in range(40)], "id int, text string, label int")
    encoded = learning.embedding_rows(learning.encode_text(df, load, batch=3))
    model = learning.train_logistic(encoded, "label", max_iter=50)
    scored = learning.score_classes(model, encoded, ["a", "b"])
    assert scored.where("predicted <> CASE label WHEN 0 THEN 'a' ELSE 'b' END").count() == 0
    chances = scored.first()["probabilities"]
    assert set(chances) == {"a", "b"} and sum(chances.values()) == pytest.approx(1.0, abs=0.002)


def test_train_and_save(spark, folder):
    rows = [(i, float(i % 5), float(i % 3), i % 5, "abcde"[i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, sugars_100g double, salt_100g double, nutriscore_label int, nutriscore_grade string")
    for train in (learning.train_forest, learning.train_boosted):
        done = learning.train_and_save(df, "id", f"{folder}/{train.__name__}", f"{folder}/metrics", train=train, fit_rows=100, max_iter=8, max_depth=3)
        assert done.accuracy == 1.0 and done.scored.count() == 60
        again = learning.load_model(spark, f"{folder}/{train.__name__}")
        assert learning.score_boosted(again, df).where("predicted_nutriscore <> nutriscore_grade").count() == 0
    assert {r["model"] for r in spark.read.parquet(f"{folder}/metrics").collect()} == {"train_forest", "train_boosted"}
    texts = df.selectExpr("id", "concat('word', id % 5, ' some more') AS text", "id % 2 AS label")
    assert learning.train_text_and_save(texts, "id", f"{folder}/text", names=["x", "y"]).report.count() == 5


def test_corpus_minimum_length(spark):
    df = spark.createDataFrame([("short", None), ("just eleven", None), ("long", "enough text")], "product_name string, ingredients_text string")
    assert learning.text_corpus(df).count() == 2
    assert learning.text_corpus(df, columns=["product_name"], longer_than=4).count() == 2


def test_scoring_corpus_takes_five_characters(spark):
    df = spark.createDataFrame([("four", None), ("five5", None), ("a", "bcd")], "product_name string, ingredients_text string")
    assert sorted(r["text"] for r in learning.query_corpus(df).collect()) == ["a bcd", "five5"]


def test_scoring_corpus_query_holds_whole_texts(spark):
    from checks.models import query_corpus_whole

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()
    whole = {r["doc_id"]: f"{r['lang'] or ''} {r['text'] or ''}".strip(" \t\n\r") for r in rows}
    got = {r["doc_id"]: r["text"] for r in query_corpus_whole(spark, folder).collect()}
    assert got == {i: t for i, t in whole.items() if len(t) >= 5}
    assert max(map(len, got.values())) > 1000


def test_report_of_the_scored_rows(spark, tmp_path):
    from dataclasses import replace

    from pyspark.ml.functions import array_to_vector

    from checks.models import _checked

    names = ["x", "y", "z"]
    # Class 0 is the largest; every tenth row has a wrong label.
    data = [(i, (c + (i % 10 == 0)) % 3, [float(c == 0), float(c == 1), i % 7 / 7]) for i in range(400) for c in [(0, 0, 1, 2)[i % 4]]]
    rows = spark.createDataFrame(data, "row_id long, label int, v array<double>").withColumn("features", array_to_vector("v"))
    trained = learning.train_text_and_save(rows, "row_id", str(tmp_path / "model"), names=names, encoder=[])
    scored = trained.scored.collect()
    assert all(r["probabilities"][r["predicted"]] == max(r["probabilities"].values()) for r in scored)
    report = {r["class"]: r for r in trained.report.collect()}
    right = sum(r["actual"] == r["predicted"] for r in scored) / len(scored)
    assert abs(trained.accuracy - right) < 1e-9 and 0.8 < right < 1
    for n in names:
        hits = sum(r["actual"] == r["predicted"] == n for r in scored)
        said, true = (sum(r[c] == n for r in scored) for c in ("predicted", "actual"))
        got = report[n]
        assert got["support"] == true
        for found, want in ((got["precision"], hits / said), (got["recall"], hits / true), (got["f1_score"], 2 * hits / (said + true))):
            assert abs(found - want) < 1e-3
    assert all(r["sound"] for r in _checked(trained, learnt=True).collect())
    # A model that guesses the largest class for all.
    guess = trained.scored.withColumn("predicted", F.lit("x"))
    matrix = evaluation.confusion_matrix(guess, "actual", "predicted", names)
    dull = replace(trained, scored=guess, report=evaluation.classification_report(matrix), accuracy=evaluation.metrics(matrix)["accuracy"])
    assert [r["class"] for r in _checked(dull, learnt=True).collect() if not r["sound"]] == ["accuracy"]


def test_describe_and_boxes(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None), (None, 5.0)], "g string, v double")
    row = statistics.describe(df, ["v"]).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (6, 1.0, 3.5, 100.0)
    boxes = {r["g"]: tuple(r)[2:] for r in statistics.box_statistics(df, "g", ["v"]).collect()}
    assert boxes["a"] == (1.0, 2.0, 3.0, 4.0, 4.0)
    assert "b" not in boxes or boxes["b"][1] is None
    counts = {r["column_name"]: r["n_null"] for r in statistics.null_counts(df).collect()}
    assert counts == {"g": 1, "v": 1}


# ---- streams ----

EVENT = "code string, v int, at int"


def land(path, name, rows, extra=()):
    import os

    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        for r in rows:
            f.write(json.dumps(dict(zip(("code", "v", "at"), r))) + "\n")
        f.writelines(line + "\n" for line in extra)


def test_append_continues_and_keeps_bad_messages_apart(spark, folder):
    land(f"{folder}/in", "1", [("a", 1, 1), ("b", 2, 1)], ["{broken", "[1]"])

    def run(pick, name):
        stream = stream_sources.file_stream(spark, f"{folder}/in", files_per_batch=1)
        rows = stream_sinks.parsed_stream(stream, EVENT)[pick]
        query = stream_sinks.append_stream(rows, f"{folder}/{name}", f"{folder}/offsets-{name}")
        query.awaitTermination()
        return query

    done = run(0, "good")
    assert stream_sinks.progress(done)["rows"] == 4
    run(1, "bad")
    read = lambda: spark.read.schema(EVENT).parquet(f"{folder}/good").count()
    assert read() == 2
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/bad").collect()) == ["[1]", "{broken"]
    run(0, "good")
    assert read() == 2
    land(f"{folder}/in", "2", [("a", 3, 2)])
    run(0, "good")
    assert read() == 3


def test_upsert_keeps_the_latest_and_can_be_compacted(spark, folder):
    land(f"{folder}/in", "1", [("a", 1, 1), ("b", 2, 5), ("a", 9, 3)])
    path = f"{folder}/log"

    def run():
        rows = stream_sinks.parsed_stream(stream_sources.file_stream(spark, f"{folder}/in", 1), EVENT)[0]
        stream_sinks.upsert_stream(rows, path, f"{folder}/offsets", ["code"], ["at"]).awaitTermination()
        return sorted(map(tuple, stream_sinks.read_upserts(spark, path, EVENT, ["code"], ["at"]).collect()))

    assert run() == [("a", 9, 3), ("b", 2, 5)]
    land(f"{folder}/in", "2", [("b", 7, 4), ("c", 1, 1), ("a", 5, 6)])
    assert run() == [("a", 5, 6), ("b", 2, 5), ("c", 1, 1)]
    assert run() == [("a", 5, 6), ("b", 2, 5), ("c", 1, 1)]
    stream_sinks.compact(spark, path, f"{folder}/log2", EVENT, ["code"], ["at"])
    assert stream_sinks.read_upserts(spark, f"{folder}/log2", EVENT, ["code"], ["at"]).count() == 3


def test_responses_land_in_few_files(spark, tmp_path, monkeypatch):
    from checks import cleaning

    rows = [(i, f"name {i}\n\"x\"", "b", i / 4) for i in range(2000)] + [(None, "no key", None, None), (7, None, "again", 1.0)]
    spark.createDataFrame(rows, "p_partkey int, p_name string, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(cleaning, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = cleaning.json_explode_products(spark, str(tmp_path))
    text = lambda v: None if v is None else str(v)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((text(k), n, b, text(p))) for k, n, b, p in rows)
    assert len(list((tmp_path / "responses").rglob("part-*"))) <= 4  # as many as tasks, not as responses


def test_frequent_values_of_one_file_each_are_written_by_tasks_of_their_own(spark, tmp_path):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.range(0, 5000, 1, 4).selectExpr("id", "substr('abcde', int(id % 5) + 1, 1) AS g")
        sinks.write_parquet(rows, f"{tmp_path}/t", "g", one_file=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    files = list((tmp_path / "t").rglob("part-*.parquet"))
    assert len(files) == 5 and len({f.name[:10] for f in files}) == 5
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5000


def test_only_the_picked_rows_reach_the_task_that_fits(spark, monkeypatch):
    from shelfgrade.operators import boosting

    plans = []
    real = boosting.stage
    monkeypatch.setattr(boosting, "stage", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    rows = spark.range(0, 400, 1, 8).selectExpr("double(id % 10) AS x", "int(id % 10 > 4) AS y", "id")
    model = boosting.fit_boosted(rows, rows.where("id % 2 = 0"), ["x"], "y", 3, 2, 0.1, 1.0, 1.0, 1)
    assert len(model.of_class) == 6
    assert "Coalesce 1" not in plans[0] and "Exchange" in plans[0]


def test_all_training_rows_are_fitted(spark, folder):
    rows = spark.range(0, 30_000, 1, 4).selectExpr("id", "double(id % 5) AS sugars_100g", "double(id % 3) AS salt_100g", "int(id % 5) AS nutriscore_label", "substr('abcde', int(id % 5) + 1, 1) AS nutriscore_grade")
    fitted = []

    def train(learn, columns, label, **settings):
        fitted.append(learn.select("id").distinct().count())
        return learning.train_boosted(learn, columns, label, **settings)

    done = learning.train_and_save(rows, "id", f"{folder}/whole", f"{folder}/whole-metrics", train=train, max_iter=3, max_depth=3)
    assert fitted == [24_000] and done.accuracy == 1.0
    assert spark.read.parquet(f"{folder}/whole-metrics").first()["n_samples"] == 24_000


def test_boosting_spread_over_tasks_gives_the_trees_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    x[:300] = x[0]  # one row many times
    label = np.clip(((x[:, 0] + x[:, 1]) * 1.5).astype(int), 0, 2)
    label[:100] = 2 - label[0]
    rows = [(*map(float, v), int(y)) for v, y in zip(x, label)]
    df = spark.createDataFrame(rows, "a double, b double, c double, nutriscore_label int").repartition(5)
    monkeypatch.setattr(boosting, "BLOCK", 400)
    settings = {"max_iter": 5, "max_depth": 3}
    one = learning.train_boosted(df, ["a", "b", "c"], **settings)
    monkeypatch.setattr(boosting, "ONE_TASK", 1000)
    monkeypatch.setattr(boosting, "CUT", 2)
    spread = learning.train_boosted(df, ["a", "b", "c"], **settings)
    assert len(spread.of_class) == 15 and not spark.sparkContext._jsc.getPersistentRDDs()
    for name in ("of_class", "feature", "threshold", "gain", "value"):
        assert np.allclose(getattr(one, name), getattr(spread, name), rtol=1e-4, atol=1e-5), name
    # With all rows and columns in each tree they are also the trees of the unfolded rows.
    whole = learning.train_boosted(df, ["a", "b", "c"], subsample=1.0, feature_subset="1.0", **settings)
    edges = boosting.bin_edges(df, ["a", "b", "c"])
    plain = list(boosting.boost(x, label, edges, 3, 5, 3, 0.1, 1.0, 1.0, 42))
    assert np.allclose(whole.value, np.array([t[5] for t in plain]), rtol=1e-4, atol=1e-5)


def test_leaves_by_look_up_are_those_of_a_walk(monkeypatch):
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 9, (4, 500))
    for level in (0, 1, 3, 6):
        feature, cut = rng.integers(0, 4, 63), rng.integers(0, 10, 63)  # a cut of 9 sends all rows left
        monkeypatch.setattr(boosting, "MASKED", 6)
        looked_up = boosting.leaves(bins, feature, cut, level, 9)
        monkeypatch.setattr(boosting, "MASKED", -1)
        assert (looked_up == boosting.leaves(bins, feature, cut, level, 9)).all()


def test_ruled_model_is_fitted_on_all_rows(spark, monkeypatch):
    from checks import models
    from shelfgrade.constants import FEATURES
    from shelfgrade.plans.views import ROW

    rows = spark.range(0, 24_000, 1, 4).selectExpr(*[f"id AS {c}" for c in ROW], *[f"double(id % {i + 7}) AS {c}" for i, c in enumerate(FEATURES)])
    fitted, real = [], learning.fit_boosted
    monkeypatch.setattr(models.views, "products", lambda spark, folder: rows)
    monkeypatch.setattr(learning, "fit_boosted", lambda train, sample, *a, **s: fitted.append(sample.count()) or real(train, sample, *a, **s))
    shown = {r["feature"]: r["decides"] for r in models.feature_importance(spark, "none").collect()}
    assert fitted == [24_000] and [c for c in FEATURES if shown[c]] == ["sugars_100g"]


def test_all_training_texts_are_fitted(spark, folder, monkeypatch):
    rows = spark.range(0, 40_000, 1, 4).selectExpr("id", "int(id % 2) AS label", "array(double(id % 2), double(id % 7)) AS embedding")
    fitted, real = [], learning.train_logistic
    monkeypatch.setattr(learning, "train_logistic", lambda learn, *a, **s: fitted.append(learn.select("id").distinct().count()) or real(learn, *a, **s))
    done = learning.train_text_and_save(learning.embedding_rows(rows), "id", f"{folder}/vectors", f"{folder}/vector-metrics", names=["0", "1"], encoder=[], max_iter=5)
    assert fitted == [32_000] and done.accuracy == 1.0
    assert spark.read.parquet(f"{folder}/vector-metrics").first()["n_samples"] == 32_000
