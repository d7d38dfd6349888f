"""Repairs against a search over all sequences of edits, and the query against plain damage and faults."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shelfgrade.llm import turn_repair
from shelfgrade.llm.queries import op13_turn_repair

PATTERN = re.compile(r"(s?(ua)+)?")


def every_repair(rows, faults, most):
    """All (cost, audit, lines) up to a cost, by plain enumeration."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        if i == len(rows) and PATTERN.fullmatch("".join(line[:1] for line in lines if not line.startswith(":"))):
            yield cost, audit, lines
        ways = [("I", 5, i, (*lines, f"{r}:")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            ways.append(("D", 2, i + 1, lines))
            if faults[i] not in (1, 2):
                more = 5 * (faults[i] == 3)
                ways.append(("K", more, i + 1, (*lines, f"{role}:{text}")))
                ways += [("R", 1 + more, i + 1, (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for letter, more, j, out in ways:
            if cost + more <= most:
                heapq.heappush(heap, (cost + more, audit + letter, j, out))


def test_search_finds_the_least():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randrange(5)
        rows = [(rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), f"t{i}") for i in range(n)]
        faults = [rnd.choice([0, 0, 0, 0, 1, 2, 3]) for _ in rows]
        cost, audit = turn_repair.cheapest("".join(r[:1] or "\0" for r, _ in rows), faults)
        lines = tuple(turn_repair.repaired_rows(iter(rows), audit))
        assert (cost, audit, lines) == min(every_repair(rows, faults, cost), key=lambda w: w[:2]), (rows, faults)


def test_long_conversations():
    rnd = random.Random(2)
    n = 50_000
    initials = "".join(rnd.choice("uas") for _ in range(n))
    cost, audit = turn_repair.cheapest(initials, [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)])
    assert sum(c != "I" for c in audit) == n
    assert turn_repair.cheapest("", []) == (0, "")


def plain(rows):
    """The query's result for rows of (conv_id, turn, role, text)."""
    after = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = after.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, here in after.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in here:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not ends else 2 if (role, text) in seen else 3 if ends[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in here if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(here, here[1:])]
        kept = [(r, t) for _, r, t in here]
        cost, audit = turn_repair.cheapest("".join(r[:1] or "\0" for r, _ in kept), faults)
        digest = hashlib.sha256("\n".join(turn_repair.repaired_rows(iter(kept), audit)).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_query(spark, tmp_path, extra):
    rnd = random.Random(4)
    texts = ["Well.", "Yes!", "no stop", "Why?", "", None, " \t", "Ends. ", "Line\none.", "long word " * 40_000 + "."]
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "Tool"]), rnd.choice(texts)) for c in range(60) for t in range(rnd.choice([1, 2, 5, 9]))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (5, None, "user", "Hm."), (7, 100, "user", "Late."), (7, 100, "user", "Late."), (7, 100, "assistant", "Tied.")]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    schema = "conv_id long, turn long, role string, text string" + (", audit int, own string, kind int" if extra else "")
    df = spark.createDataFrame([(*r, 1, "x", 2) if extra else r for r in rows], schema).repartition(6)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in op13_turn_repair(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert got[conv] == row, conv


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13_turn_repair(spark, str(tmp_path)).count() == 0
