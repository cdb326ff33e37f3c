"""Conversation repair against a plain search over all edits, and its long path against the short one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from touchline.llm import conversations as C

GRAMMAR = re.compile("(s?(ua)+)?")
WHITE = " \t\n\v\f\r"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.strip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) by going through the rows with all prefixes of the grammar's words as states, and the repaired rows."""
    faults = plain_faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}  # the last initial says what may follow
    name = {"u": "user", "a": "assistant"}
    now = {"": (0, "", ())}

    def grown(states):
        todo = list(states)
        while todo:
            last = todo.pop()
            for x in follow[last]:
                if x in name:
                    cost, audit, made = states[last]
                    new = (cost + 3, audit + "I", (*made, (name[x], "")))
                    if x not in states or new < states[x]:
                        states[x] = new
                        todo.append(x)
        return states

    now = grown(now)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for last, (cost, audit, made) in now.items():
            options = [(last, cost + 4, audit + "D", made)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(x, cost + more, audit + "K", (*made, (role, text))) for x in follow[last] if role[:1] == x]
                options += [(x, cost + 3 + more, audit + "R", (*made, (name[x], text))) for x in follow[last] if x in name]
            for x, *label in options:
                if x not in after or tuple(label) < after[x]:
                    after[x] = tuple(label)
        now = grown(after)
    return min(now[x] for x in ("", "a") if x in now), faults


def plain_report(rows):
    """Everything that the query returns for a conversation's damaged rows, in order."""
    (cost, audit, made), faults = plain_repair(rows)
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in made))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    """Of (conv_id, turn, role, text) rows, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def all_edits(codes_rows):
    """Every way to repair, with at most two inserted turns in each place."""
    faults = plain_faults(codes_rows)
    best = None
    options = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r[1]), ("R", "user"), ("R", "assistant")]) for r, f in zip(codes_rows, faults, strict=True)]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for chosen in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(codes_rows) + 1):
            roles, audit, cost = [], "", 0
            for i, put in enumerate(extra):
                roles += put
                audit += "I" * len(put)
                cost += 3 * len(put)
                if i < len(chosen):
                    letter, role = chosen[i]
                    audit += letter
                    cost += C.COSTS[letter] + (3 if letter != "D" and faults[i] == "truncated" else 0)
                    roles += [role] if letter != "D" else []
            if GRAMMAR.fullmatch("".join(x[:1] or "-" for x in roles)) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]
TEXTS = ["Hello.", "Well", "", "  ", "Yes!", "Why?", "No.", "Then\n", "Über …", "Hello."]


def conversation(rng, n):
    turns = sorted(rng.choice([None, *range(n + 3)]) or i for i in range(n))
    return [(t, rng.choice(ROLES), rng.choice(TEXTS)) for t in turns]


def codes_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        out.append(C.coded(role, text, (role, text) in seen)[1])
        seen.add((role, text))
    return "".join(out)


@pytest.mark.parametrize("seed", range(30))
def test_cheapest_is_the_best_of_all_edits(seed):
    rng = random.Random(seed)
    rows = conversation(rng, rng.randint(0, 3))
    assert C.cheapest(codes_of(rows)) == all_edits(rows) == plain_repair(rows)[0][:2]


def test_cheapest_of_longer_conversations_and_of_stretches(monkeypatch):
    rng = random.Random(5)
    for n in [*range(4, 40), 150, 400]:
        rows = conversation(rng, n)
        (cost, audit, made), _ = plain_repair(rows)
        codes = codes_of(rows)
        assert C.cheapest(codes) == (cost, audit)
        roles, texts, state = C.edited(audit, [r[1:] for r in rows])
        assert list(zip(roles, texts, strict=True)) == list(made) and state in C.ACCEPTING
        with monkeypatch.context() as m:
            m.setattr(C, "SEGMENT", 5)
            assert C.cheapest(codes) == (cost, audit)


SCHEMA = "conv_id long, turn long, role string, text string, conv_ID2 string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def table_rows():
    rng, rows = random.Random(8), []
    for conv in range(60):
        for turn, role, text in conversation(rng, rng.randint(1, 12)):
            rows.append((conv, turn, role or None, f"{text} {rng.randint(0, 3)}." if text and rng.random() < 0.5 else text or None))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (61, None, "user", "Hi."), (61, None, "user", "Hi.")]
    drop = next(i for i in range(100, 1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (drop, 0, "user", "All of it goes."), *((70, t, "user" if t % 2 else "assistant", f"Turn {t % 90}." if t % 7 else "so") for t in range(300))]


def reported(df):
    return {r.conv_id: tuple(r[1:]) for r in df.select("conv_id", *C.COUNTS, "audit", "repaired_sha256").collect()}


def test_reports_of_damaged_turns(spark):
    turns, want = turns_of(spark, table_rows()), {c: plain_report(r) for c, r in plain_damage(table_rows()).items()}
    assert reported(C.reports(turns, C.damage(turns))) == want
    assert sum(x[-2] == "" for x in want.values()) >= 1


def test_long_conversations_give_the_same(spark, monkeypatch):
    turns, want = turns_of(spark, table_rows()), {c: plain_report(r) for c, r in plain_damage(table_rows()).items()}
    assert reported(C.reports(turns, C.damage(turns), long_rows=3)) == want
    monkeypatch.setattr(C, "PIECE_BYTES", 200)
    assert reported(C.reports(turns, C.damage(turns), long_rows=3, long_bytes=100)) == want
    pieces = C.repair(C.damage(turns), long_rows=50).where("conv_id = 70").orderBy("piece").collect()
    assert "".join(p.edits for p in pieces) == want[70][-2]
    whole = C.repair(C.damage(turns)).where("conv_id = 70").first()
    assert [t for p in pieces for t in p.turns] == whole.turns


def test_empty_table(spark):
    turns = turns_of(spark, [])
    assert C.reports(turns, C.damage(turns)).count() == 0 and C.repair(turns).count() == 0
