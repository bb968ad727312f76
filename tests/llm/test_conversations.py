"""Conversation repair against a search over the grammar's states, and on the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from ledgerlake.llm import conversations as C
from ledgerlake.llm import queries

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def search(turns, fault):
    """(cost, audit, repaired): the least of all edits, state by state of the grammar; nothing is shared with the operator."""
    step = {("0", "s"): "s", ("0", "u"): "a", ("s", "u"): "a", ("a", "a"): "u", ("u", "u"): "a"}
    role = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for c in "ua":
                    if (state, c) in step:
                        best_of(best, step[state, c], (cost + 5, audit + "I", (*out, (role[c], ""))))
        return best

    def best_of(best, state, new):
        if state not in best or new[:2] < best[state][:2]:
            best[state] = new

    now = inserted({"0": (0, "", ())})
    for (who, text), f in zip(turns, fault, strict=True):
        then = {}
        for state, (cost, audit, out) in now.items():
            best_of(then, state, (cost + 2, audit + "D", out))
            if f not in ("blank", "duplicate"):
                cost += 5 * (f == "truncated")
                if (state, who[:1]) in step:
                    best_of(then, step[state, who[:1]], (cost, audit + "K", (*out, (who, text))))
                for c in "ua":
                    if (state, c) in step:
                        best_of(then, step[state, c], (cost + 1, audit + "R", (*out, (role[c], text))))
        now = inserted(then)
    return min(now[s] for s in "0u" if s in now)


def brute(rows, ids):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in ids:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, fault = set(), []
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        n = {t for t, _, _ in own if t is not None}
        cost, audit, fixed = search([r[1:] for r in own], fault)
        broken = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, max(n) - min(n) + 1 - len(n) if n else 0, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), broken, cost, audit, sha))
    return sorted(out, key=str)


def made(seed, sizes):
    rng, out = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for k in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][k % 2]
            role = rng.choice(["system", "tool", None, "", "Ü"]) if rng.random() < 0.1 or (k == 0 and rng.random() < 0.3) else role
            text = rng.choice(["Yes.", "No!", "What", "é?", None, " \n", "", "tail. \n", "a.b", f"t{k}.", f"t{k}.", f"t{k}", f"t{k}"])
            out.append((None if conv == 3 else conv, None if rng.random() < 0.05 else k + (k > 5), role, text))
    return out


def got(df):
    cols = ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversations(spark, sf)) == brute(damage(rows), {r[0] for r in rows})


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,long,chunk", [(1, 4096, 1024), (2, 12, 8), (3, 0, 1), (4, 0, 5)])
def test_against_search(spark, seed, long, chunk):
    """Whole, and dealt out in chunks."""
    rows = made(seed, [0, 1, 2, 3, 60, 25, *range(1, 24), *[5] * 20])
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], KIND + ", cost int, `a.b` string")
    assert got(C.audited(C.damaged(df), keep="keep", long_turns=long, chunk_turns=chunk)) == brute(damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("turns", [1, 2, 3, 256])
def test_tables_meet(monkeypatch, turns):
    """Many conversations of every kind, cut in tables of any size."""
    monkeypatch.setattr(C, "TURNS", turns)
    rng = random.Random(turns)
    for _ in range(1500):
        n = rng.randrange(1, 12)
        talk = [(rng.choice(["user", "assistant", "system", "user", "assistant", "x"]), f"{k}.") for k in range(n)]
        fault = [rng.choice(["", "", "", "blank", "truncated", "duplicate"]) for _ in talk]
        s = C.Stretch(C._coded(talk, fault), True)
        cost, audit = min(s.best(C.START, C.START), s.best(C.START, C.USER))
        want = search(talk, fault)
        assert (cost, audit, tuple(C.applied(audit, talk, C.START)[0])) == want, (talk, fault)


def test_long_one_in_chunks(spark):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{rng.randrange(900)}" + "." * rng.randrange(2)) for k in range(3000)] + [(1, 5, "user", "again and again.")] * 700 + [(2, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    want = brute(rows, {1, 2})
    assert got(C.audited(df, long_turns=500)) == want
    for long in (500, 10_000):
        fixed = C.repaired(df, long_turns=long).orderBy("conv_id", "part", "no", "pos").collect()
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in fixed if r.conv_id == 1).encode()).hexdigest() == dict((w[0], w[-1]) for w in want)[1]
        assert all(r.conv_id == 1 for r in fixed)


def test_nothing_left(spark):
    df = spark.createDataFrame([(1, 4, "user", "a.", False), (None, None, None, None, False), (2, 1, "user", "Hm.", True)], KIND + ", keep boolean")
    none = hashlib.sha256(b"").hexdigest()
    for long in (10, 0):
        assert got(C.audited(df, keep="keep", long_turns=long)) == sorted([(1, *[0] * 6, "", none), (None, *[0] * 6, "", none), (2, *[0] * 5, 2, "D", none)], key=str)
    assert C.audited(df.limit(0), keep="keep").count() == 0
    big = spark.createDataFrame([(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "end.")], KIND)
    assert C.audited(big).first().audit == "KK" and C.audited(big, long_bytes=1000).first().audit == "KK"
