"""Conversation repair against enumeration and against a row-by-row automaton."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from probscape.llm import conversations, queries

WHITE = " \t\n\x0b\x0c\r"
ROW = "extra string, role string, text string, conv_id long, turn long, cost long"


def faults(rows):
    """First fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(WHITE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(role, fault):
    yield 4, "D", None
    if fault not in ("blank", "duplicate"):
        stays = 3 if fault == "truncated" else 0
        yield stays, "K", role
        yield 3 + stays, "R", "user"
        yield 3 + stays, "R", "assistant"


def enumerated(rows):
    """Least (cost, audit) of all edits of a few rows, with up to two insertions in every place."""
    inserts = [tuple(x) for n in range(3) for x in itertools.product(["user", "assistant"], repeat=n)]
    places = [[(3 * len(x), "I" * len(x), list(x)) for x in inserts]]
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        places += [[(c, e, [r] if r is not None else []) for c, e, r in options(role, fault)], places[0]]
    best = None
    for pick in itertools.product(*places):
        roles = [r for _, _, made in pick for r in made]
        if all(roles) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)):
            found = (sum(p[0] for p in pick), "".join(p[1] for p in pick))
            best = min(best or found, found)
    return best


STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def forward(rows):
    """Least (cost, audit, repaired) by states after each row."""

    def inserted(states):
        for _ in range(2):
            for s, (c, a, t) in list(states.items()):
                for role in ("user", "assistant"):
                    to = STEPS.get((s, role[0]))
                    if to is not None:
                        new = (c + 3, a + "I", [*t, f"{role}:"])
                        states[to] = min(states.get(to, new), new)
        return states

    states = inserted({0: (0, "", [])})
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for s, (c, a, t) in states.items():
            for cost, edit, made in options(role, fault):
                to = s if made is None else STEPS.get((s, made[:1]))
                if to is not None:
                    new = (c + cost, a + edit, t if made is None else [*t, f"{made}:{text}"])
                    after[to] = min(after.get(to, new), new)
        states = inserted(after)
    return min(states[s] for s in (0, 3) if s in states)


def brute(rows):
    """The contract's rows from (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if role is None else role), (" " if text is None else text)
            name = ":".join(" " if v is None else str(v) for v in (conv, turn))
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [(r, t) for _, r, t in kept]
        found, turns = faults(pairs), {t for t, _, _ in kept if t is not None}
        cost, audit, text = forward(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return out


def key(r):
    return tuple((v is not None, v) for v in r)


def got(spark, rows):
    made, copies = conversations.damaged(spark.createDataFrame([("x", r[2], r[3], r[0], r[1], 5) for r in rows], ROW).repartition(3))
    return [tuple(r) for r in conversations.repairs(made, copies).collect()]


def test_cells_against_enumeration():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), rng.choice(["A.", "B!", "cut", " ", "D?"])) for _ in range(rng.randrange(4))]
        codes = "".join(
            "d" if f in ("blank", "duplicate") else (role[:1] if role[:1] in ("s", "u", "a") else "o").upper() if f == "truncated"
            else role[:1] if role[:1] in ("s", "u", "a") else "o" for (role, _), f in zip(rows, faults(rows), strict=True))
        assert conversations.cheapest(conversations.parse(codes)) == enumerated(rows) == forward(rows)[:2], rows


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None, -1]:
        n = rng.choice([1, 2, 3, 8, 20])
        for turn in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, "é. ", "a\x0b?\x0c", f"Own {conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 3, None]), role, text))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 900}.") for t in range(1500)]
    rows += [(1001, 5, "user", "Same again.")] * 300 + [(1002, 1, "user", "x" * 2_000_000 + "."), (1002, 2, "assistant", "y" * 1_000_000)]
    rows += [(2000 + k, 0, "user", "Hi.") for k in range(60)]
    assert sorted(got(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert got(spark, []) == []


def test_repaired_rows_give_the_digest(spark):
    rng = random.Random(6)
    rows = [("x", rng.choice(["system", "user", "assistant", "tool"]), f"Text {rng.randrange(4)}" + rng.choice([".", ""]), c, t, 1) for c in range(20) for t in range(9)]
    table = spark.createDataFrame(rows, ROW)
    found = conversations.repairs(table)
    out = {}
    for r in conversations.repaired_rows(table, found).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert re.fullmatch("[KRI]", r.edit)
    for r in found.collect():
        assert hashlib.sha256("\n".join(out.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out.get(r.conv_id, [])))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op13_conversation_repair"](spark, folder)
    assert sorted(map(tuple, found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())) == sorted(brute(rows))
    assert found.agg(F.sum("cost")).first()[0] > 0
