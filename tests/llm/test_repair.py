"""Repairs against a plain search over all edits of each conversation."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tradeweft.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, cost int, block string"


def white(t):
    return t.strip(" \t\n\x0b\x0c\r")


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def brute(rows):
    out = {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        out[row[0]].append(row[1:])
    return sorted(map(repr, (one(conv, own) for conv, own in out.items())))


def one(conv, rows):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = white(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0

    @lru_cache(None)
    def best(i, kept, inserted):
        """kept: initials so far, shortened to what matters; at most two insertions in a row."""
        found = []
        if i == len(rows) and kept in ("", "ua"):
            found.append((0, "", ()))
        into = {"": "u", "s": "u", "u": "a", "ua": "u"}[kept]
        after = {"u": "u", "a": "ua"}
        name = {"u": "user", "a": "assistant"}[into]
        if inserted < 2:
            c, a, t = best(i, after[into], inserted + 1)
            found.append((c + 5, "I" + a, (name + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, kept, 0)
            found.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                stump = 5 * (faults[i] == "truncated")
                if role[:1] == into or (role[:1] == "s" and kept == ""):
                    c, a, t = best(i + 1, "s" if role[:1] == "s" else after[into], 0)
                    found.append((c + stump, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, after[into], 0)
                found.append((c + 1 + stump, "R" + a, (f"{name}:{text}", *t)))
        return min(found) if found else (10**6, "", ())

    for i in range(len(rows), -1, -1):
        for kept in ("", "s", "u", "ua"):
            best(i, kept, 0)
    cost, audit, lines = best(0, "", 0)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "umpire", "User"]
TEXTS = ["", None, " \n", "Yes.", "Well?", "and then", "so!", "no", "é.", "a . ", "x.\n"]


def some_rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        style = rng.random()
        for turn in range(rng.randrange(most)):
            if style < 0.5:
                rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"{rng.random()}" + rng.choice([".", ".", "!", ""])))
            else:
                rows.append((conv, rng.choice([turn, None, 3]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def test_small_conversations(spark):
    rows = some_rows(1, 250, 9) + [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (7, 0, "user", "a")] * 2
    assert got(R.repair(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("bits,reach", [(0, 2), (2, 2), (3, 64)])
def test_chunks_meet(spark, monkeypatch, bits, reach):
    """Long conversations in small blocks; some where vectors never converge, since all rows have to go."""
    monkeypatch.setattr(R, "BLOCK_BITS", bits)
    monkeypatch.setattr(R, "REACH", reach)
    rows = some_rows(bits, 6, 60)
    rows += [(100, t, "user", "same") for t in range(80)] + [(101, t, "assistant", f"cut {t}") for t in range(80)]
    rows += [(102, t, "au"[t % 2], f"{t}.") for t in range(90)] + [(103, t, "user", f"{t}.") for t in range(50)]
    assert got(R.repair(frame(spark, rows))) == brute(rows)


def test_given_table_and_nothing(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(R.repair(table)) == brute(rows)
    assert got(R.repair(table.limit(0))) == []


def test_vectors_are_few_and_steps_right():
    table = R.steps()
    assert len(table.vectors) < 100
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randrange(1, 40)))
        old, new = rng.randrange(len(table.vectors)), rng.randrange(len(table.vectors))
        assert table.rerun(codes, old, new, table.run(codes, old)) == table.run(codes, new)
