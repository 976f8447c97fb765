"""Conversation repair against all edits, and against the query's SQL."""

import hashlib
import random
import re
import zlib

import oracle
import pytest

from claimloom.llm import conversations, queries

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def every_edit(rows, faults, before="", at=0, inserts=0):
    """(cost, audit, lines) of all ways, with at most two inserts in a row."""
    if at == len(rows) and before in ("", "a"):
        yield 0, "", []
    if inserts < 2:
        who = "a" if before == "u" else "u"
        for cost, audit, lines in every_edit(rows, faults, who, at, inserts + 1):
            yield cost + 3, "I" + audit, [{"u": "user:", "a": "assistant:"}[who], *lines]
    if at == len(rows):
        return
    role, text = rows[at]
    for cost, audit, lines in every_edit(rows, faults, before, at + 1):
        yield cost + 4, "D" + audit, lines
    if faults[at] in ("blank", "duplicate"):
        return
    more = 3 if faults[at] == "truncated" else 0
    if role[:1] and role[:1] in NEXT[before]:
        for cost, audit, lines in every_edit(rows, faults, role[:1], at + 1):
            yield cost + more, "K" + audit, [f"{role}:{text}", *lines]
    who = "a" if before == "u" else "u"
    for cost, audit, lines in every_edit(rows, faults, who, at + 1):
        yield cost + more + 3, "R" + audit, [{"u": "user:", "a": "assistant:"}[who] + text, *lines]


def slow(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        said = [r[1:] for r in rows]
        cost, audit, lines = min(every_edit(said, faults))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, table, extra=True):
    rows = spark.createDataFrame([(*r, 7, "x") for r in table], "conv_id long, turn long, role string, text string, fault int, seen string")
    got = conversations.repair(conversations.with_faults(conversations.damaged(rows))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def some(seed, conversations_, most=5):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "agent", None, "", "tool"], ["Yes.", "Yes.", "no", " \n", "", None, "What? ", "Ünï.\t", "a.b", "x!"]
    return [(c, r.choice([0, 1, 2, 3, 4, 9, None]), r.choice(roles), r.choice(texts)) for c in [None, *range(conversations_)] for _ in range(r.randint(1, most))]


@pytest.mark.parametrize("seed", range(2))
def test_every_edit_gives_the_same(spark, seed):
    table = some(seed, 120, 4)
    assert found(spark, table) == slow(table)


@pytest.mark.parametrize(("piece", "slice_rows"), [(1, 1), (1, 2), (2, 3), (3, 7)])
def test_pieces_and_slices_change_nothing(spark, monkeypatch, piece, slice_rows):
    table = some(7, 60, 9)
    whole = found(spark, table)
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "SLICE_ROWS", slice_rows)
    assert found(spark, table) == whole


def test_a_long_conversation_is_put_together_from_pieces(spark, monkeypatch):
    r = random.Random(3)
    table = [(5, turn, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"No {turn}.", f"hm {turn}", ""])) for turn in range(3000)]
    whole = found(spark, table)
    monkeypatch.setattr(conversations, "PIECE", 4000)  # one recursion over all of it
    assert found(spark, table) == whole and len(whole[5][6]) > 2700


def test_edges(spark):
    assert found(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 9)
    got = found(spark, [(dropped, 1, "user", "Hi."), (kept, 1, "user", "x" * 3_000_000), (-4, -(1 << 63), "user", "a."), (-4, (1 << 63) - 1, "assistant", "b.")])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[kept][3] == 1 and got[-4][0] in (0, (1 << 63) - 1)


def test_query_and_sql(spark, small):
    got = queries.queries()["op13_recursive_repair"](spark, small)
    assert oracle.difference(got, oracle.connect(small), conversations.ORACLE_SQL) is None
