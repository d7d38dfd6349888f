"""Cheapest repair of conversations whose turns are lost, empty, cut, repeated or out of turn.

Edits take the rows of a conversation in order: Keep (0), Rerole to user or assistant (1), Delete (2; the
only choice for blank and repeated rows), and Insert an empty user or assistant row anywhere (5). A cut row that
is not deleted costs 5 more. The roles' initials that are left must read ``(s?(ua)+)?``. Of the cheapest
sequences of edits the one whose initials, the audit, are least in ASCII is taken.

Depth-first branch-and-bound over nodes (row, state of the role pattern) with an explicit stack. Edges
are tried in ASCII order, so of two ways of the same cost to a node the first has the smaller audit: neither
can be the start of the other, as inserts alone, which take no row, raise the cost. A node's dominance entry
is the least cost with which it was entered; worse or equal prefixes end there. Suffix lower bounds are
the costs of the rows behind without regard to the audit, taken backwards over rows and states, which makes
them exact: a prefix is followed only if its cost and bound are below the incumbent (cost, audit), or equal to the
bound of the root while there is no incumbent, so the search walks straight to the optimum and the bound of the
root is the proof. Time and memory grow in proportion to the rows.

Spark deals conversations over tasks and sorts their rows; a task streams them. It holds a few bytes
a row of one conversation (initial, fault, bounds, a digest of role and text), not the texts: the audit goes
to a second pass, which streams the rows again and feeds the repaired texts to the hash. The hash and audit of
a conversation are one value each and sequential by their nature, so one conversation is one task's work.

Defined results: a missing conversation id, turn, role or text reads as one space where it is joined
or compared; rows are taken by turn (missing first), then role and text; a role's initial is its first
character, an empty role has none and adds nothing to the pattern; repeated rows are faults (duplicate);
a conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfgrade.staging import scope, stage

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
CUT_COST, REROLE, DELETE, INSERT = 5, 1, 2, 5
_WHITE = " \t\n\x0b\x0c\r"
# States of the role pattern: nothing yet, after s, after u, after a. Steps: initial -> state.
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_DONE = (True, False, False, True)
_NEXT = ("u", "u", "a", "u")  # the only initial that an edit can give in a state
_FAR = 1 << 60
_ROLES = {"u": "user", "a": "assistant"}


def fault_of(text: str) -> int:
    """Blank or truncated, from the text alone."""
    kept = text.rstrip(_WHITE)
    return BLANK if not kept else 0 if kept[-1] in ".!?" else TRUNCATED


def _edges(state: int, initial: str, fault: int):
    """(letter, cost, next state) of the edits of a row, in ASCII order."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT_COST if fault == TRUNCATED else 0
    kept = _STEPS[state].get(initial) if initial else state
    if kept is not None:
        yield "K", extra, kept
    yield "R", extra + REROLE, _STEPS[state][_NEXT[state]]


def suffix_bounds(initials: str, faults) -> np.ndarray:
    """bounds[i, state]: the least cost of the rows from i on, entered in a state."""
    n = len(initials)
    bounds = np.empty((n + 1, 4), np.int64)
    now = [0 if done else _FAR for done in _DONE]
    for i in range(n, -1, -1):
        if i < n:
            after = now
            now = [min(cost + after[to] for _, cost, to in _edges(s, initials[i].strip("\0"), faults[i])) for s in range(4)]
        for _ in range(3):  # chains of inserts
            now = [min(now[s], INSERT + now[_STEPS[s][_NEXT[s]]]) for s in range(4)]
        bounds[i] = now
    return bounds


def cheapest(initials: str, faults) -> tuple[int, str]:
    """The least (cost, audit) for rows with these role initials (NUL: none) and faults."""
    n = len(initials)
    bounds = suffix_bounds(initials, faults)
    best_cost, best_audit = int(bounds[0, 0]), None
    entered: dict[tuple[int, int], int] = {}
    audit = bytearray()
    stack = [(0, 0, 0, 0, 0)]  # row, state, cost, length of the audit before, letter
    while stack:
        i, state, cost, length, letter = stack.pop()
        total = cost + int(bounds[i, state])
        if total > best_cost or (best_audit is not None and total >= best_cost) or entered.get((i, state), _FAR) <= cost:
            continue
        entered[i, state] = cost
        del audit[length:]
        if letter:
            audit.append(letter)
        if i == n and _DONE[state]:
            best_cost, best_audit = cost, audit.decode()
        length = len(audit)
        children = list(_edges(state, initials[i].strip("\0"), faults[i])) if i < n else []
        rows = [(i + 1, to, cost + more, length, ord(name)) for name, more, to in children]
        rows.append((i, _STEPS[state][_NEXT[state]], cost + INSERT, length, ord("I")))
        stack.extend(sorted(rows, key=lambda r: -r[4]))  # the least letter is popped first
    return best_cost, best_audit or ""


def repaired_rows(rows, audit: str):
    """The lines ``role:text`` of a repaired conversation; ``rows`` are (role, text) in order."""
    rows, state = iter(rows), 0
    for letter in audit:
        if letter == "I":
            state = _STEPS[state][initial := _NEXT[state]]
            yield f"{_ROLES[initial]}:"
            continue
        role, text = next(rows)
        if letter == "K":
            state = _STEPS[state][role[:1]] if role else state
            yield f"{role}:{text}"
        elif letter == "R":
            state = _STEPS[state][initial := _NEXT[state]]
            yield f"{_ROLES[initial]}:{text}"


_FOUND = pa.schema([("conv", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_LEGAL = {"su", "ua", "au"}


def _by_conversation(batches, columns):
    """(conversation, iterator of rows) of rows sorted by conversation; each must be read to its end."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == conv:
                yield held[1:]
                held = next(rows, None)

        yield conv, own()


def _search(batches):
    for conv, rows in _by_conversation(batches, ("conv", "role", "text")):
        initials, faults, seen, illegal, before = [], bytearray(), set(), 0, None
        for role, text in rows:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = fault_of(text)
            faults.append(DUPLICATE if fault != BLANK and digest in seen else fault)
            seen.add(digest)
            illegal += before is not None and before + role[:1] not in _LEGAL
            before = role[:1]
            initials.append(role[:1] or "\0")
        cost, audit = cheapest("".join(initials), faults)
        found = [conv, *(sum(f == kind for f in faults) for kind in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, _FOUND.types)], schema=_FOUND)


def _hash(batches):
    for conv, rows in _by_conversation(batches, ("conv", "role", "text", "audit")):
        audit = next(rows)[2]
        digest, first = hashlib.sha256(), True
        for line in repaired_rows(((role, text) for role, text, _ in rows), audit):
            digest.update((line if first else f"\n{line}").encode())
            first = False
        for _ in rows:  # rows that the audit does not reach: none
            pass
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [digest.hexdigest()]})


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Faults, cost, audit and repaired hash of each conversation of ``df``, with its gaps in turns."""
    spark = df.sparkSession
    key, place = F.col(f"`{conv}`"), F.col(f"`{turn}`")
    read = df.select(
        F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).alias("conv"), key.alias("own"), place.alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text")
    )
    with scope(spark) as keep:
        rows = stage(read, "turns").frame
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        spans = rows.groupBy("conv").agg(F.first("own").alias(conv), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
        # Batches are small, as texts can be long.
        order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
        found = stage(rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(_search, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits").frame
        audits = found.select("conv", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(df.schema[turn].dataType).alias("turn"), "audit", F.lit(0).alias("kind"))
        both = audits.unionByName(rows.select("conv", "role", "text", "turn", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind")))
        hashed = both.repartition("conv").sortWithinPartitions("conv", "kind", *order[1:]).select("conv", "role", "text", "audit").mapInArrow(_hash, "conv string, repaired_sha256 string")
        result = stage(spans.join(found, "conv").join(hashed, "conv").drop("conv"), "repaired")
        keep(result)
    return result.frame.select(f"`{conv}`", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, drawn by CRC32 of ``conversation:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes its full stops, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(20))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), draw.alias("draw")).where("draw <> 0")
    changed = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    speaker = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv", "turn", speaker.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))
