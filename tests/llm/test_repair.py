import hashlib
import itertools
import random
import re
import zlib

import pytest

from jobsieve.llm import repair


def brute(rows):
    """All edit sequences: rows of (initial, doomed, stay)."""
    best, n = None, len(rows)
    # an edit per row with up to two inserts before each row and at the end
    for kinds in itertools.product("DKR", repeat=n):
        for inserts in itertools.product(range(3), repeat=n + 1):
            audit, cost, seq, ok = "", 0, "", True
            for i in range(n + 1):
                for _ in range(inserts[i]):
                    seq += "a" if seq[-1:] == "u" else "u"
                    audit, cost = audit + "I", cost + 2
                if i == n:
                    break
                initial, doomed, stay = rows[i]
                audit += kinds[i]
                if kinds[i] == "D":
                    cost += 3
                elif doomed:
                    ok = False
                elif kinds[i] == "K":
                    seq, cost = seq + (initial or "?"), cost + stay
                else:
                    seq, cost = seq + ("a" if seq[-1:] == "u" else "u"), cost + 2 + stay
            if ok and re.fullmatch("(s?(ua)+)?", seq) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_is_optimal():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("ssuuaax"), rng.random() < 0.2, rng.randrange(2)) for _ in range(rng.randrange(5))]
        assert repair.search(rows) == brute(rows), rows


def test_long_conversation_is_quick():
    rows = [("u", False, 1)] * 512
    cost, audit = repair.search(rows)
    assert cost == 512 + 2 * 256 and len(audit) >= 512


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows, damaged):
    """conv -> the result by one search over the whole conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).digest()))
        faults, seen, counts = [], set(), dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faults.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = repair.search(faults)
        left, lines, state = iter(mine), [], ""
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter != "D":
                if letter != "K":
                    role = "assistant" if state == "u" else "user"
                state = role[:1]
                lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        out[conv] = dict(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
                         illegal=sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
                         cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in list(range(40)) + [None]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 2])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]),
                         rng.choice(["Yes.", "No!", "why", "  ", "", None, f"t{rng.random()}.", "é? \n"])))
    # one conversation with far more rows than the others together, and one very long text
    rows += [(1000, i, "user" if i % 2 else "assistant", rng.choice([f"text {i}.", f"text {i}", "again.", ""])) for i in range(700)]
    rows += [(1001, 0, "user", "x" * 300_000 + "?"), (1001, 1, "assistant", "done."), (1002, 0, "user", "q?"), (1002, 0, "user", "q?")]
    return rows


@pytest.mark.parametrize("piece", [512, 3])
def test_damage_report(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = conversations()
    df = spark.createDataFrame([(*r, "K", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, seg int").repartition(5)
    got = {r.conv_id: r.asDict() for r in repair.damage_report(df).collect()}
    want = expected(rows, damage(rows))
    assert got.keys() == want.keys()
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv


def test_repaired_rows_give_the_hash(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 4)
    df = spark.createDataFrame([r for r in conversations() if r[0] is None or r[0] < 30], "conv_id bigint, turn bigint, role string, text string")
    report = {r.conv_id: r for r in repair.repair_report(df).collect()}
    lines = {}
    for r in repair.repaired_turns(df).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    for conv, r in report.items():
        mine = lines.get(conv, [])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in mine).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _, _ in mine))
        assert "".join(e for _, _, e in mine) == r.audit.replace("D", "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.damage_report(df).count() == 0
    assert repair.repaired_turns(df).count() == 0
