"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

ROWS = "conv_id long, turn long, role string, text string, lang string, part int"
SHAPE = re.compile(r"(s?(ua)+)?")
SPACE = "\x20\t\n\x0b\x0c\r"


def brute(rows):
    """rows (role, text) in order -> (faults, cost, audit, repaired rows) by uniform-cost search."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and SHAPE.fullmatch(initials):
            return faults, cost, audit, out
        state = (i, initials[-1:])
        if state in done:
            continue
        done.add(state)
        options = [("I", 2, i, ("user", "")), ("I", 2, i, ("assistant", ""))]
        if i < len(rows):
            options.append(("D", 3, i + 1, None))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                role, text = rows[i]
                options += [("K", more, i + 1, (role, text)), ("R", 2 + more, i + 1, ("user", text)), ("R", 2 + more, i + 1, ("assistant", text))]
        for edit, c, j, row in options:
            new = out + (row,) if row else out
            shape = "".join(r[:1] if r[:1] else "?" for r, _ in new)
            if any(SHAPE.fullmatch(shape + rest) for rest in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, audit + edit, j, new))
    raise AssertionError


def expected(rows):
    """rows of the original table -> the query's rows by conversation."""
    say = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in [r[:4] for r in rows if r[0] == conv]:
            role, text = say(role), say(text)
            hit = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            after += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, cost, audit, mended = brute([r[1:] for r in after])
        turns = [r[0] for r in after if r[0] is not None]
        first = [r[1][:1] for r in after]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest())
    return out


def made(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        turn = 0
        for _ in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No!", "é why?", "cut off", "", "  \n", None, "ok.\n ", "Hm\x85", str(r.random()) + "."])
            rows.append((conv, None if r.random() < 0.1 else turn, role, text, None, 3))
            if r.random() < 0.1:
                rows.append(rows[-1])
            turn += r.choice([0, 1, 1, 1, 1, 3])
    r.shuffle(rows)
    return rows


def got(spark, rows):
    from eventfold.llm import conversations
    df = conversations.repair_damaged(spark.createDataFrame(rows, ROWS).repartition(3))
    return [(r[0], tuple(r)[1:]) for r in df.collect()]


def test_vectors_against_search():
    from eventfold.llm import conversations as c
    r = random.Random(3)
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", "", "c!", str(r.random())])) for _ in range(r.randint(0, 9))]
        faults, cost, audit, out = brute(rows)
        kinds = [c.GONE if f in ("blank", "duplicate") else ("sua".find(role[0]) % 4) + 4 * (f == "truncated") for (role, _), f in zip(rows, faults, strict=True)]
        assert c.walk(kinds, c.END, 0, True)[0] == audit
        assert min(a + b for a, b in zip(c.least_costs(kinds)[:4], c.END, strict=True)) == cost
        roles, texts = c.repaired([x for x, _ in rows], [x for _, x in rows], audit, 0)
        assert tuple(zip(roles, texts, strict=True)) == out


@pytest.mark.parametrize(("longest", "block"), [(12, 4096), (30, 3), (30, 1)])
def test_query_against_search(spark, monkeypatch, longest, block):
    """Also with blocks of few rows, so that conversations span blocks and tasks."""
    from eventfold.llm import conversations
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rows = made(longest + block, 25, longest)
    out = got(spark, rows)
    assert len(out) == len(dict(out)) and dict(out) == expected(rows)


def test_empty_and_dropped(spark):
    assert got(spark, []) == []
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(conv, 0, "user", "Hi.", None, 1)]) == [(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]


def test_a_conversation_of_copies_and_a_long_text(spark):
    rows = [(5, 1, "user", "same.", None, 1)] * 3000 + [(5, i, "assistant", "x" * 200_000 + ".", None, 1) for i in (2, 3)]
    assert dict(got(spark, rows)) == expected(rows)
