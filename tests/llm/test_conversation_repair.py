"""Conversation repair against a plain dynamic program over suffixes, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from kinetable.llm import conversation_repair as cr

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\f\r"


def by_hand(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), straight from the contract."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        have = convs.setdefault(conv, [])
        if kind != 0:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            have += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: repaired(sorted(have, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, have in convs.items()}


def repaired(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACES)
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    # states: nothing yet, after s, after u, after a; best edits of each suffix
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        out = dict(best)
        for _ in range(3):
            for (s, x), to in step.items():
                if x in name and to in out:
                    cost, audit, said = out[to]
                    cand = (cost + 5, "I" + audit, [f"{name[x]}:", *said])
                    out[s] = min(out.get(s, cand), cand)
        return out

    best = with_inserts({0: (0, "", []), 3: (0, "", [])})
    for (_, role, text), fault in list(zip(rows, faults))[::-1]:
        now = {}
        for s in best:
            cands = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("b", "d"):
                for x in "sua":
                    if (s, x) in step and step[s, x] in best and (x != "s" or role[:1] == "s"):
                        cost, audit, said = best[step[s, x]]
                        keep = role[:1] == x
                        cands.append((cost + (not keep) + 5 * (fault == "t"), ("K" if keep else "R") + audit, [f"{role if keep else name[x]}:{text}", *said]))
            now[s] = min(cands)
        best = with_inserts(now)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = best[0]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in "bdt"], pairs, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def found(df, **limits):
    rows = cr.report(df, **limits).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got, want = found(df), by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got == want


def odd_rows():
    rng = np.random.default_rng(5)
    texts = ["yes.", "no", " ", "", None, "why?", "wait! ", "é…", "x" * 30_000 + ".", "a\tb.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(int(i), int(t), roles[rng.integers(8)], texts[rng.integers(10)]) for i in range(80) for t in range(rng.integers(1, 9))]
    rows += [(500, None if t % 7 == 0 else t // 2, roles[rng.integers(5)], f"{texts[rng.integers(8)]}{rng.integers(90)}.") for t in range(700)]
    rows += [(501, 3, "user", "the same.")] * 60 + [(None, 1, "user", "hi."), (None, None, None, None), (502, None, "user", "a."), (502, None, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("rows, size", [(2048, 1 << 20), (5, 1 << 20), (2048, 40)])
def test_odd_rows_and_cut_conversations(spark, rows, size):
    given = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in given], "conv_id long, turn long, role string, text string, n int, fault string").repartition(5)
    assert found(df, block_rows=rows, block_bytes=size) == by_hand(given)
    assert cr.report(df.limit(0)).count() == 0


def test_blocks_compose_to_the_whole(spark):
    """Blocks inside a task: the worker's own cut, without Spark's borders."""
    rng = np.random.default_rng(9)
    rows = [("sua"[rng.integers(3)], int(rng.choice([0, 0, 0, 1, 2, 3])), int(rng.choice([1, 1, 2]))) for _ in range(60)]
    whole = cr.ended(cr.summary(rows, 0))
    now = {0: (0, "")}
    for at in range(0, 60, 7):
        after = {}
        for s, (cost, audit) in now.items():
            for way in cr.ways(rows[at : at + 7]):
                if way["start"] == s:
                    cand = (cost + way["cost"], audit + way["audit"])
                    after[way["stop"]] = min(after.get(way["stop"], cand), cand)
        now = after
    assert whole == min((a + b, x + y) for k, (a, x) in now.items() for b, y in [cr.closing(k)])


def test_undamaged_rows_that_read_right_stay(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a."), (2, 5, "user", "q?"), (2, 6, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cr.report(df, cr.undamaged).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[2]["cost"], got[2]["audit"]) == (0, "KKK", 0, "KK")
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:s.\nuser:q?\nassistant:a.").hexdigest()
