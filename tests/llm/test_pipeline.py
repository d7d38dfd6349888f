"""The pipeline's stages against brute force, on whole small tables and on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from shelfgrade.llm import pieces, queries, secret_scan
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}
    frames, now = [], docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stage(step(spark, now, FOLDER), "test").frame
        assert now.schema.simpleString() == docs.schema.simpleString()
        frames.append(now)
    kept = [{r.doc_id: r for r in f.collect()} for f in frames]

    # Toxicity: the same model, each text's score by itself.
    scored = queries.op9_toxicity(spark, FOLDER).collect()
    assert set(kept[0]) == {r.doc_id for r in scored if not r.flagged}
    # Near copies: fingerprints and links by hand.
    prints = {i: brute.fingerprint(r.text) for i, r in kept[0].items()}
    groups = brute.roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i in sorted(prints):
        least.setdefault(groups[prints[i]], i)
    assert set(kept[1]) == set(least.values())
    # Benchmark: no window of an item is left, and only documents with one went.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = brute.windows(items, 10)
    assert set(kept[2]) == {i for i, r in kept[1].items() if not brute.hits(r.text, windows)[0]}
    # Secrets: masked as found by hand.
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        spans = sum(secret_scan.find(source[i].text), [])
        assert {(k, a, b) for a, k, b in spans if k < 3} == {(secret_scan.KINDS.index(k), a, b) for k, a, b in brute.secrets(source[i].text)}
        assert r.text == secret_scan.masked(source[i].text, spans, "<secret>") and r.n_chars == len(r.text)
    # Pieces: every text comes back.
    vocab = pieces.Vocabulary(queries.PIECES)
    last = corpus_pipeline.encode_pieces(spark, now, FOLDER).collect()
    assert {r.doc_id for r in last} == set(kept[3])
    for r in last:
        assert r.round_trip and pieces.decode_ids(vocab, r.piece_ids) == r.text and r.n_pieces == len(r.piece_ids)


def test_run(spark):
    out = queries.pipeline(spark, FOLDER)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 50 < out.count() < 200 and out.where("NOT round_trip").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, fp long, ids string, pos int"
CLASHES = ("_mark", "_first", "_doc", "_hash", "_rest", "_key", "a.b")


def test_stages_on_odd_rows(spark):
    texts = [None, "", "password = hunter2hunter2", "x " * 30000, "same words again here", "same words again here", "\n", "😀"]
    data = [(i, t, "en", None, None, 0.5, "clash", 1, "c", 2) for i, t in enumerate(texts)] + [(None, "no id", None, "s", 5, None, None, None, None, None)]
    data += [data[4], data[8]]
    docs = spark.createDataFrame(data, ODD).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES}).repartition(3)
    for step, want in [
        (corpus_pipeline.reject_toxic, 11),
        (corpus_pipeline.drop_near_copies, 6),
        (corpus_pipeline.drop_contaminated, 11),
        (corpus_pipeline.mask_secrets, 11),
        (corpus_pipeline.encode_pieces, 11),
    ]:
        out = step(spark, docs, FOLDER)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.count() == want, step.__name__
        kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
        assert out.select(*kept).exceptAll(docs.select(*kept)).isEmpty(), step.__name__
        assert step(spark, docs.limit(0), FOLDER).count() == 0
    assert {r.text for r in corpus_pipeline.mask_secrets(spark, docs, FOLDER).collect()} >= {None, "", "<secret>"}
