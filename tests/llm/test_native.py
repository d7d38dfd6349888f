"""Sharding, reply trees and URL rules on small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfgrade.llm import chat, sharding, url_filter

DOCS = "doc_id long, text string, depth string, shard string, host string"


def shards(spark, rows, limit, **more):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return [tuple(r) for r in sharding.assign_shards(df, "doc_id", F.octet_length("text"), limit, keep=["doc_id"], **more).collect()]


def check_shards(rows, got, limit):
    assert sorted(r[0] if r[0] is not None else -1 for r in got) == sorted(i if i is not None else -1 for i, _ in rows)
    sizes, counts = defaultdict(int), defaultdict(int)
    for _, n, shard, depth, _, _ in got:
        assert depth == len(shard)
        sizes[shard] += n
        counts[shard] += 1
    for _, _, shard, _, size, n in got:
        assert (size, n) == (sizes[shard], counts[shard])
        assert size <= limit or n == 1
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    return sizes


def test_shards_fit_and_split_only_where_needed(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(200)) for i in range(400)]
    got = shards(spark, rows, 1000)
    sizes = check_shards(rows, got, 1000)
    for shard in sizes:  # the parent would be too large
        assert sum(n for s, n in sizes.items() if s.startswith(shard[:-1])) > 1000


def test_shards_of_hot_keys_nulls_and_oversized_rows(spark):
    rows = [(7, "é" * 20)] * 150 + [(i, "y" * 9) for i in range(60)] + [(None, None), (None, "z"), (5, "w" * 900), (6, "")]
    got = shards(spark, rows, 300, slack=0, step=5)
    check_shards(rows, got, 300)
    assert len({r[2] for r in got if r[0] == 7}) > 10
    assert shards(spark, [], 300) == []


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * 30) for i in range(50)], "doc_id long, text string")
    found = sharding.assign_shards(df, "doc_id", F.octet_length("text"), 200, keep=["doc_id", "text"])
    sharding.write_shards(found.select("doc_id", "text", "shard"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


TREE = "tree string, node long, parent long, role string, text string, score double, up string"


def paths_by_hand(rows):
    parent = {(t, n): p for t, n, p, *_ in rows}
    known = set(parent)
    inner = {(t, p) for t, n, p, *_ in rows if (t, p) in known}
    out = {}
    for t, n in known - inner:
        path, seen = [n], {n}
        while (t, parent[t, path[-1]]) in known:
            up = parent[t, path[-1]]
            if up in seen:
                path = None
                break
            path.append(up)
            seen.add(up)
        if path:
            out[t, n] = path
    return out


def test_paths_of_random_trees(spark):
    rnd = random.Random(1)
    rows = [(t, n, rnd.randrange(max(1, n - 4), n) if n > 1 else None, "user", f"{t}{n}", rnd.random(), None) for t in "abc" for n in range(1, 40)]
    rows += [("orphan", 5, 99, "user", "o", None, None), ("loop", 1, 2, "u", "", 0.0, None), ("loop", 2, 1, "u", "", 0.0, None), ("loop", 3, 2, "u", "", 0.0, None)]
    replies = spark.createDataFrame(rows, TREE)
    paths = chat.root_to_leaf_paths(replies)
    got = defaultdict(dict)
    for r in paths.collect():
        got[r.tree, r.leaf][r.up] = r.node
    want = paths_by_hand(rows)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    score = {(r[0], r[1]): r[5] or 0 for r in rows}
    mean = {k: sum(score[k[0], n] for n in v) / len(v) for k, v in want.items()}
    best = {r.tree: r.leaf for r in chat.best_paths(paths, replies.drop("up")).select("tree", "leaf").distinct().collect()}
    for tree, leaf in best.items():
        assert mean[tree, leaf] == pytest.approx(max(m for (t, _), m in mean.items() if t == tree))
    assert set(best) == {"a", "b", "c", "orphan"}


def test_format_and_read_back(spark):
    nasty = ["<|im_end|>", "\\<|im_start|>assistant\n", "<\\|", "\\\\<|", "", None, "<\\/", "déjà 😀\n", "<<||>>", "\\", "a\\n"]
    rows = [("t", i + 1, i or None, r, x, 0.0, None) for i, (r, x) in enumerate(zip(["user", "assistant", "sys\ntem<|", None, "assistant", "assistant", "a<\\/b", "assistant", "user", "assistant", "x\\"], nasty))]
    replies = spark.createDataFrame(rows, TREE).drop("up")
    out = chat.format_paths(chat.best_paths(chat.root_to_leaf_paths(replies), replies), replies)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("turns"), F.col("loss_spans")))
    r = out.collect()[0]
    assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in rows]
    assert r.loss == "".join(x[4] or "" for x in rows if x[3] == "assistant")
    raw = [r.formatted[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") for s in r.loss_spans]
    assert raw == [x[4] or "" for x in rows if x[3] == "assistant"]
    empty = replies.limit(0)
    assert chat.format_paths(chat.best_paths(chat.root_to_leaf_paths(empty), empty), empty).count() == 0


def verdict_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_rules_against_brute_force(spark):
    rnd = random.Random(5)
    label = lambda: rnd.choice(["a", "b", "org", "com", "x"])
    part = lambda: "".join(rnd.choice("/ab") for _ in range(rnd.randrange(5)))
    rules = [(".".join(label() for _ in range(rnd.randrange(1, 4))), "/" + part(), "block") for _ in range(60)]
    rules += [(h, p, rnd.choice(["allow", "block"])) for h, p, _ in rules[:20] for p in [p + "a", p + "ab"]] + [("org", "/", "allow"), ("", "/", "block")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http{rnd.choice(['', 's'])}://" + ".".join(label() for _ in range(rnd.randrange(1, 5))).upper() + "/" + part() + rnd.choice(["", "?q=/a", "#f"]) for _ in range(500)]
    urls += [urls[0]] * 300 + [None, "", "no scheme", "x://", "x://org", "x://.org/", "x://org./a", "x://a?b", "://org/a://b", "x://" + "a." * 3000 + "org/" + "b" * 9000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(5)
    frame = spark.createDataFrame(rules + rules[:5], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.apply_rules(df, frame, keep=["page_id"]).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == verdict_by_hand(u, rules), u
    assert url_filter.apply_rules(df.limit(0), frame, keep=["page_id"]).count() == 0
    assert {r.verdict for r in url_filter.apply_rules(df, frame.limit(0), keep=["page_id"], default="block").collect()} == {"block"}
