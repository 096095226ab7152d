"""Conversation repair against enumeration of all edits, a left-to-right search and all CYK splits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from eventide.llm import turn_repair as T
from eventide.llm.common import read_table

SCHEMA = "conv_id long, turn long, role string, text string, span int, kind string, n int, cost string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def enumerated(symbols):
    """Least (cost, audit) over every choice of edits with at most two turns inserted at a place."""
    inserts = [(c, "I" * len(c)) for k in range(3) for c in map("".join, itertools.product("ua", repeat=k))]

    def options(s):
        more = 3 if s.isupper() else 0
        yield 4, "D", ""
        if s.lower() in "sua":
            yield more, "K", s.lower()
        if s == "o" or s == "O":
            yield more, "K", "o"
        if s != "x":
            yield 3 + more, "R", "u"
            yield 3 + more, "R", "a"

    best = None
    for gaps in itertools.product(inserts, repeat=len(symbols) + 1):
        for edits in itertools.product(*map(options, symbols)):
            made = gaps[0][0] + "".join(e[2] + g[0] for e, g in zip(edits, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", made):
                audit = gaps[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, gaps[1:]))
                found = sum(e[0] for e in edits) + 3 * audit.count("I"), audit
                best = found if best is None or found < best else best
    return best


def left_to_right(symbols):
    """Least (cost, audit) by states of the whole prefix, another algorithm than the intervals."""
    def spread(states):
        for _ in range(3):
            for p, (c, a) in list(states.items()):
                q = 3 if p == 2 else 2
                if q not in states or (c + 3, a + "I") < states[q]:
                    states[q] = (c + 3, a + "I")
        return states

    states = spread({0: (0, "")})
    for s in symbols:
        after, more = {}, 3 if s.isupper() else 0
        for p, (c, a) in states.items():
            user_next = p != 2
            moves = [(4, "D", p)]
            if s.lower() == "s" and p == 0:
                moves.append((more, "K", 1))
            if s.lower() == "u" and user_next or s.lower() == "a" and not user_next:
                moves.append((more, "K", 2 if user_next else 3))
            if s != "x":
                moves.append((3 + more, "R", 2 if user_next else 3))
            for cost, e, q in moves:
                if q not in after or (c + cost, a + e) < after[q]:
                    after[q] = (c + cost, a + e)
        states = spread(after)
    return min(states[q] for q in (0, 3) if q in states)


def test_cells_equal_enumeration():
    for n in range(3):
        for s in itertools.product("suaoSUAOx", repeat=n):
            assert T.answer(T.cells_of("".join(s))) == enumerated(s), s
    rng = random.Random(1)
    for _ in range(12):
        s = "".join(rng.choices("suaoSUAOx", k=3))
        assert T.answer(T.cells_of(s)) == enumerated(s), s


def test_cells_equal_left_to_right_search_on_long_conversations():
    rng = random.Random(2)
    for n in [*range(1, 40), 200, 1500]:
        s = "".join(rng.choices("suaoSUAOx", weights=[1, 8, 8, 1, 1, 3, 3, 1, 3], k=n))
        assert T.answer(T.cells_of(s)) == left_to_right(s)


def test_one_split_is_as_good_as_all():
    """Textbook CYK over all splits of all spans gives the cells that the tree of halves gives."""
    rng = random.Random(3)
    for _ in range(40):
        s = "".join(rng.choices("suaoUAx", k=rng.randrange(1, 9)))

        @lru_cache(maxsize=None)
        def span(i, j, s=s):
            if j - i == 1:
                return T.terminal(s[i])
            every = [T.combined(span(i, k), span(k, j)) for k in range(i + 1, j)]
            return tuple(tuple(min((c[p][q] for c in every if c[p][q]), default=None) for q in T.STATES) for p in T.STATES)

        assert span(0, len(s)) == T.cells_of(s)


def brute(rows):
    """The contract over plain rows (conv_id, turn, role, text) before damage."""
    out = {}
    gone = lambda v: " " if v is None else v
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        k = zlib.crc32(f"{gone(conv)}:{gone(turn)}".encode()) % 20
        role, text = gone(role), gone(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, turns in kept.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        initials = [r[:1] for _, r, _ in turns]
        known = [t for t, _, _ in turns if t is not None]
        cost, audit = left_to_right(symbols)
        made, state, it = [], 0, iter(turns)
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(it)
            if e in "IR":
                role = "assistant" if state == 2 else "user"
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                made.append(f"{role}:{text}")
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def rows_of(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def made_up(n_conv, rng, turns=12):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Longer text. And", "é?", None, "a\x85b.", "x. \x0b"]
    rows = []
    for c in range(n_conv):
        for t in range(rng.randrange(turns)):
            rows.append((c, t + 3 * (rng.random() < .1), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice(texts) if rng.random() < .5 else f"Text {rng.random()}."))
    return [r for i, r in enumerate(rows) if not any(r[:2] == s[:2] for s in rows[max(0, i - 15):i])]  # one row per turn


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    df = read_table(spark, f"/root/testdata/{sf}", "conversations")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert rows_of(T.repaired(*T.damaged(df))) == want


def test_random_conversations(spark):
    rows = made_up(300, random.Random(4)) + [(None, t, "user" if t % 2 else "assistant", f"t {t}.") for t in range(30)]
    rows += [(1000, None, "user", "no turn."), (1001, 2**62, "user", "far."), (1001, -2**61, "system", "near.")]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(7)
    assert rows_of(T.repaired(*T.damaged(df))) == brute(rows)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A hot conversation lies in many tasks and in many spans; the result is that of the whole."""
    monkeypatch.setattr(T, "SPAN_ROWS", 64)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), "The same text." if rng.random() < .3 else f"Own {t}.") for t in range(6000)]
    rows += [(c, t, "user", "Hello.") for c in range(100, 120) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    thin = T.spans(T.marked(T._rows(df)))
    assert thin.where("conv_id = 7").count() > 8
    assert rows_of(T.repaired(*T.damaged(df))) == brute(rows)


def test_equal_rows_and_order_of_ties(spark):
    rows = [(1, 0, "user", "Hi.")] * 5 + [(1, 0, "assistant", "Yes.")] * 3 + [(2, None, "user", "Hi."), (2, 1, "user", "Hi."), (2, None, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(T.repaired(df))
    assert got[1][:7] == (0, 0, 6, 0, 6, 30, "IKDDKDDDDI")  # the assistant's rows stand first
    assert got[2][2] == 2
    assert got == rows_of(T.repaired(df.repartition(5)))


def test_dropped_and_empty(spark):
    ids = spark.createDataFrame([(5,), (5,), (6,), (None,)], "conv_id long")
    df = spark.createDataFrame([(5, 1, "user", "Hi."), (5, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = rows_of(T.repaired(df, ids))
    assert got[6] == nothing and got[None] == nothing and got[5][5:7] == (0, "KK")
    none = spark.createDataFrame([], SCHEMA)
    assert T.repaired(*T.damaged(none)).collect() == [] and T.repaired_turns(none).collect() == []


def test_repaired_turns_read_right(spark):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in made_up(200, random.Random(6))], SCHEMA)
    digests = {r.conv_id: r.repaired_sha256 for r in T.repaired(df).collect()}
    turns = {}
    for r in sorted(T.repaired_turns(df).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(turns.setdefault(r.conv_id, [])) and (r.source_turn is None) == (r.edit == "I")
        turns[r.conv_id].append((r.role, r.text))
    for conv, made in turns.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest() == digests[conv]
