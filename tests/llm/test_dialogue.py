"""op13_dialogue against a plain search over (cost, audit), on the query's own rows and on odd ones."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from ridgeline.llm import dialogue

from .conftest import DATA

BLANK = " \t\n\x0b\x0c\r"


def broken(rows):
    out = {}
    for conv, turn, role, text in rows:
        filled = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        how = zlib.crc32(":".join(filled[:2]).encode()) % 20
        role, text = filled[2:]
        role = "user" if how == 4 else role
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(how, 1))
    return out


def plain(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(BLANK)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, made):
        """(cost, audit, lines) from row i, with ``made`` the role initials so far, cut to what matters."""
        options = []
        if i == len(rows) and made.rstrip("?") in ("", "a"):
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            if made.count("?") < 3 and follows(made.rstrip("?"), role[0]):
                cost, audit, lines = best(i, role[0] + "?" * (made.count("?") + 1))
                options.append((2 + cost, "I" + audit, ((role + ":"), *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            bare, late = made.rstrip("?"), faults[i] == "truncated"
            cost, audit, lines = best(i + 1, bare)
            options.append((3 + cost, "D" + audit, lines))
            for to in ("user", "assistant", role):
                if faults[i] not in ("blank", "duplicate") and follows(bare, to[:1]):
                    cost, audit, lines = best(i + 1, to[0])
                    options.append((2 * (to != role) + late + cost, "RK"[to == role] + audit, (f"{to}:{text}", *lines)))
        return min(options, default=(1 << 30, "", ()))

    def follows(made, x):
        return {"": x in ("s", "u"), "s": x == "u", "u": x == "a", "a": x == "u"}[made] and x != ""

    cost, audit, lines = best(0, "")
    initials = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = [plain(c, r) for c, r in broken(rows).items()]
    found = dialogue.op13_dialogue(spark, DATA).collect()
    assert order(found) == order(want)
    assert all(re.fullmatch("[DIKR]*", r.audit) for r in found)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \n", None, "What?", "ends! \t", "é.", "中", "x" * 20_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "usr", "User", "agent"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:3] if c % 3 else roles), rng.choice(texts if c % 2 else texts[:2])) for c in range(120) for t in range(rng.randrange(1, 9))]
    return rows + [(None, t, "user", "Yes.") for t in range(6)] + [(200, None, None, None)] * 3 + [(201, 5, "user", "same")] * 4


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS conv", "'x' AS symbol", "3 AS digest")


@pytest.mark.parametrize("most", [100_000, 3])
def test_odd_rows(spark, odd, most):
    """Also with conversations in blocks of three rows."""
    found = dialogue.repaired(dialogue.damaged(table(spark, odd)), most).collect()
    assert order(found) == order([plain(c, r) for c, r in broken(odd).items()])


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in dialogue.repaired(dialogue.damaged(table(spark, [(gone, 0, "user", "Hi.")]))).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert dialogue.repaired(dialogue.damaged(table(spark, []))).count() == 0


def test_one_conversation_is_most_rows(spark):
    """60,000 rows of one id, a third of them of one text, beside small conversations: in blocks, as without."""
    rows = spark.range(60_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id % 3 = 0, 'ok.', concat('text ', id, '.')) AS text")
    rows = rows.unionByName(spark.range(300).selectExpr("100 + id DIV 3 AS conv_id", "id % 3 AS turn", "'user' AS role", "concat(id, '!') AS text"))
    cut = dialogue.repaired(dialogue.damaged(rows), 1000).collect()
    assert order(cut) == order(dialogue.repaired(dialogue.damaged(rows)).collect())
    assert max(len(r.audit) for r in cut) > 55_000 and len(cut) == 101


def test_states_are_few():
    found = dialogue.Repairs()
    found.close()
    assert len(found.vectors) < 64


def test_scan_equals_trace(spark):
    rng, auto = random.Random(1), dialogue.repairs()
    for _ in range(500):
        symbols = [rng.randrange(dialogue.SYMBOLS) for _ in range(rng.randrange(12))]
        behind, cost = auto.scan(symbols)
        place, total = 0, 0
        for x, state in zip(symbols, behind, strict=True):
            _, c, place = auto.arcs(state, x, place)
            total += c
        assert total + 2 * len(auto.ending(place)) == cost
