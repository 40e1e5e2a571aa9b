"""Conversation repair against a search over all edits of small conversations, and stretches against whole searches."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from voxloom.llm import conversation_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def damage(rows):
    """(conversations, rows after damage) in order, by the contract's words."""
    convs, out = set(), []
    for conv, turn, role, text in rows:
        convs.add(conv)
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    groups = defaultdict(list)
    for conv, turn, role, text in out:
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        groups[conv].append((turn is not None, turn or 0, digest, role, text, turn))
    return convs, {c: [(x[5], x[3], x[4]) for x in sorted(v, key=lambda x: x[:3])] for c, v in groups.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def by_hand(rows):
    """The contract's report by breadth: all (role initials so far) of a pattern's prefix, cheapest cost and least audit."""
    told = faults(rows)
    best = {"": (0, "", [])}  # at most one s, then the parity: kept as the whole string of initials, small conversations only

    def grow(s, v):
        yield s, v
        for n in (1, 2, 3):  # inserts in a row
            for roles in itertools.product(("user", "assistant"), repeat=n):
                t = s + "".join(r[0] for r in roles)
                if legal(t):
                    yield t, (v[0] + 5 * n, v[1] + "I" * n, v[2] + [f"{r}:" for r in roles])

    def legal(s):
        return re.fullmatch(r"s?(ua)*u?", s) is not None

    def keep_best(pairs):
        out = {}
        for s, v in pairs:
            if s not in out or v[:2] < out[s][:2]:
                out[s] = v
        return out

    for (_, role, text), fault in zip(rows, told):
        spread = keep_best(x for s, v in best.items() for x in grow(s, v))
        step = []
        for s, (cost, audit, lines) in spread.items():
            step.append((s, (cost + 2, audit + "D", lines)))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role and legal(s + role[0]):
                    step.append((s + role[0], (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                for r in ("user", "assistant"):
                    if legal(s + r[0]):
                        step.append((s + r[0], (cost + 1 + extra, audit + "R", [*lines, f"{r}:{text}"])))
        best = keep_best(step)
    ends = [v for s, v in ((s, v) for s0, v0 in best.items() for s, v in grow(s0, v0)) if PATTERN.fullmatch(s)]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


@pytest.fixture(scope="module")
def fixture(spark):
    rng = random.Random(5)
    base = []
    for conv in [*range(300), None]:
        base += [r for r in _table(rng, conv)]
    base += [(300, 0, "user", "Same."), (300, 0, "user", "Same."), (300, None, "user", "Same."), (300, 1, "assistant", "Fine.")]
    clash = [(*r, "d", 7, "x", 1) for r in base]
    return base, spark.createDataFrame(clash, "conv_id long, turn long, role string, text string, digest string, fault int, edit string, place int").repartition(3)


def _table(rng, conv):
    out = []
    for turn in range(rng.randint(1, 7)):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(["system", "tool", "", None, "User"])
        text = rng.choice(["Yes.", "No!", "a word", "  ", "", None, "Why?\n", "x. ", "é", "a\u0085", "good.", f"t{turn}."])
        out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return out


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_against_all_edits(spark, fixture, partitions):
    base, conversations = fixture
    convs, groups = damage(base)
    want = {c: by_hand(groups.get(c, [])) for c in convs}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in cr.digests(cr.repair(cr.damaged(conversations))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()


def test_one_long_conversation_in_stretches(spark, monkeypatch):
    """A conversation over many tasks and blocks has the edits of one search over all of it."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}.", f"{t}!"])) for t in range(900)]
    convs, groups = damage(rows)
    codes = [(r[:1], ["", "blank", "duplicate", "truncated"].index(f)) for (_, r, _), f in zip(groups[1], faults(groups[1]))]
    cost, audit = cr.search(codes, cr.START, cr.ENDS, cr.suffix_bounds(codes, cr.ENDS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(cr, "BLOCK", 50)
        full = cr.ordered(cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
        parts = sorted(cr.stretches(full).collect(), key=lambda r: r.part)
        got = cr.digests(cr.repair(cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and (got[0].cost, got[0].audit) == (cost, audit)
    assert cr.summary([p.fragment.asDict(recursive=True) for p in parts])["audit"] == audit


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes."), (1, 3, "user", ""), (2, 0, "user", "Only.")]
    got = [tuple(r) for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("report").collect()]
    assert sorted(x for x in got if x[1]) == [(1, 1, "K", "system", "Be kind."), (1, 2, "R", "user", "Hello."), (1, 3, "K", "assistant", "Yes.")]


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.digests(cr.repair(cr.damaged(none))).count() == 0
