"""Repair of conversation structure by depth-first branch-and-bound over the edits of a conversation's rows.

Rows are sorted by conversation and turn over range partitions, so that a conversation of any length lies over many
tasks. Each task searches its stretch of a conversation for the cheapest edits between any two states of the role
pattern; the stretches of a conversation then chain up. A second pass applies the edits while the texts stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_batches, written

SPACES = " \t\n\x0b\x0c\r"
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or re-roled row has in each state.
TURN_OF = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5  # costs; CUT_OFF: an undeleted row that ends without a full stop
GOOD, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Rows that are searched at once; longer stretches are chained.
BLOCK = 4096
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FRAGMENT = (
    "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "first string, last string, ways array<struct<enter:int,leave:int,cost:long,audit:string>>"
)

Row = tuple[str, int]  # initial of the role, fault
Way = tuple[int, str]  # cost, audit


def edits(row: Row, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row in a state, in the order of letters."""
    initial, fault = row
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (state, initial) in NEXT:
            found.append(("K", extra, NEXT[state, initial]))
        found.append(("R", REROLE + extra, NEXT[state, TURN_OF[state][0]]))
    return found


def suffix_bounds(rows: list[Row], leave: tuple[int, ...]) -> list[list[int]]:
    """For each row and state what the rest costs at least until a state of `leave`."""
    bounds = [[0] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for q in STATES:
            if i == len(rows):
                bounds[i][q] = 0 if q in leave else NEVER
            else:
                bounds[i][q] = min(cost + bounds[i + 1][to] for _, cost, to in edits(rows[i], q))
        for _ in range(3):  # rows may be inserted before this one
            for q in STATES:
                bounds[i][q] = min(bounds[i][q], INSERT + bounds[i][NEXT[q, TURN_OF[q][0]]])
    return bounds


def search(rows: list[Row], enter: int, leave: tuple[int, ...], bounds: list[list[int]]) -> Way | None:
    """The cheapest edits from a state to one of `leave`, the ASCII-least of equal cost.

    Depth first with an explicit stack. Children go by bound, then letter; so of two prefixes of equal bound the one
    that comes later has the greater audit, and nothing that is not cheaper than the incumbent, or than what reached
    the same node before, needs a second look.
    """
    incumbent: Way | None = None
    reached: dict[tuple[int, int], int] = {}
    stack = [(0, enter, 0, None)]
    while stack:
        i, state, cost, trail = stack.pop()
        bound = cost + bounds[i][state]
        if bound >= NEVER or (incumbent and bound >= incumbent[0]) or cost >= reached.get((i, state), NEVER):
            continue
        reached[i, state] = cost
        if i == len(rows) and state in leave:
            letters = []
            at = trail
            while at:
                at, letter = at
                letters.append(letter)
            incumbent = (cost, "".join(reversed(letters)))
        ways = [(letter, cost + c, i + 1, to) for letter, c, to in edits(rows[i], state)] if i < len(rows) else []
        ways.append(("I", cost + INSERT, i, NEXT[state, TURN_OF[state][0]]))
        ways.sort(key=lambda w: (w[1] + bounds[w[2]][w[3]], w[0]), reverse=True)
        stack += [(at, to, c, (trail, letter)) for letter, c, at, to in ways]
    return incumbent


def ways_through(rows: list[Row], enter: tuple[int, ...], leave: tuple[int, ...]) -> dict[tuple[int, int], Way]:
    """The best way between each two states."""
    found = {}
    for out in leave:
        bounds = suffix_bounds(rows, (out,))
        found |= {(q, out): w for q in enter if (w := search(rows, q, (out,), bounds))}
    return found


def chain(one: dict[tuple[int, int], Way], two: dict[tuple[int, int], Way]) -> dict[tuple[int, int], Way]:
    """Ways through one stretch and then another. No cheapest way of a whole conversation inserts a row (to delete a
    neighbour is cheaper), so audits that compete have one length and the least parts make the least whole."""
    out: dict[tuple[int, int], Way] = {}
    for (a, b), (cost, audit) in one.items():
        for (c, d), (more, rest) in two.items():
            if b == c:
                way = (cost + more, audit + rest)
                out[a, d] = min(out.get((a, d), way), way)
    return out


class Stretch:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, enter: tuple[int, ...]):
        self.enter, self.ways, self.open = enter, {(q, q): (0, "") for q in enter}, []
        self.faults, self.rows, self.illegal, self.turns = [0] * 5, 0, 0, 0
        self.low = self.high = self.first = self.last = None

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self.rows += 1
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.open.append((initial, fault))
        if len(self.open) >= BLOCK:
            self.close()

    def close(self, leave: tuple[int, ...] = tuple(STATES)) -> None:
        middle = tuple(sorted({b for _, b in self.ways}))
        self.ways, self.open = chain(self.ways, ways_through(self.open, middle, leave)), []

    def fragment(self, leave: tuple[int, ...]) -> dict:
        self.close(leave)
        ways = [{"enter": a, "leave": b, "cost": c, "audit": x} for (a, b), (c, x) in sorted(self.ways.items())]
        named = dict(rows=self.rows, blank=self.faults[BLANK], duplicate=self.faults[DUPLICATE], truncated=self.faults[TRUNCATED])
        return named | dict(illegal=self.illegal, turns=self.turns, low=self.low, high=self.high, first=self.first, last=self.last, ways=ways)


def summary(fragments: list[dict]) -> dict:
    """The report on a conversation from its stretches in order."""
    ways, out = {(START, START): (0, "")}, dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0)
    low = high = last = None
    turns = 0
    for f in fragments:
        if not f["rows"]:
            continue
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += f[name]
        out["illegal"] += last is not None and last + f["first"] not in LEGAL
        last = f["last"]
        if f["low"] is not None:
            turns += f["turns"] - (f["low"] == high)
            low, high = f["low"] if low is None else low, f["high"]
        ways = chain(ways, {(w["enter"], w["leave"]): (w["cost"], w["audit"]) for w in f["ways"]})
    out["gaps"] = high - low + 1 - turns if turns else 0
    cost, audit = min(w for (_, b), w in ways.items() if b in ENDS)
    return out | dict(cost=cost, audit=audit)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _in_batches(records: Iterator[dict], schema: pa.Schema, rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows and about so many characters of text."""
    held, chars = [], 0
    for record in records:
        held.append(record)
        chars += len(record.get("text") or "") + len(record.get("audit") or "")
        if len(held) >= rows or chars >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, maybe copy and present) with digest, initial and fault."""
    whole = {"copy": F.col("copy") if "copy" in rows.columns else F.lit(0), "present": F.col("present") if "present" in rows.columns else F.lit(True)}
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), *[c.alias(k) for k, c in whole.items()])
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ending = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(~F.col("present"), ABSENT)
        .when(ending == "", BLANK)
        .when(F.substring(ending, -1, 1).isin(".", "!", "?"), GOOD)
        .otherwise(TRUNCATED)
    )
    return named.select("*", digest.alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


PLACE = ["turn", "digest", "copy"]


def stretches(rows: DataFrame) -> DataFrame:
    """(conv_id, part, fragment): what each task finds of a conversation, from the rows of `ordered` without texts.

    A row is a duplicate when an earlier one has its role and text (compared by SHA-256).
    """
    slim = rows.select("conv_id", *PLACE, "initial", "fault")
    place = ["turn", "copy"]
    live = F.col("fault") != ABSENT
    # One row for each role and text: the first place, and only where there is a second.
    first = slim.filter(live).groupBy("conv_id", "digest").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("many")).filter("many > 1")
    told = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    # Equal rows of one place count up: all but one of them are duplicates.
    counted = slim.groupBy("conv_id", *PLACE, "initial", "fault").agg(F.count("*").alias("n")).join(told, same, "left")
    later = F.col("first").isNotNull() & (F.col("first") != F.struct(*place))
    again = F.when(F.col("fault").isin(BLANK, ABSENT), F.col("fault")).otherwise(F.lit(DUPLICATE))
    listed = counted.select("conv_id", *PLACE, "initial", F.when(later, again).otherwise(F.col("fault")).alias("fault"), again.alias("again"), "n")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, part int, fragment struct<{_nested(FRAGMENT)}>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def found():
            part, key, now = TaskContext.get().partitionId(), object(), None
            for r in _records(batches):
                if r["conv_id"] != key:
                    if now:  # the conversation ends inside this task
                        yield {"conv_id": key, "part": part, "fragment": now.fragment(ENDS)}
                    key, now = r["conv_id"], Stretch((START,) if now else tuple(STATES))
                if r["fault"] != ABSENT:
                    for k in range(r["n"]):
                        now.add(r["initial"], r["again"] if k else r["fault"], r["turn"])
            if now:
                yield {"conv_id": key, "part": part, "fragment": now.fragment(tuple(STATES))}

        yield from _in_batches(found(), arrow, rows=64)

    dealt = listed.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("digest"), F.col("copy")).sortWithinPartitions("conv_id", *PLACE)
    return dealt.mapInArrow(run, schema)


def _nested(ddl: str) -> str:
    """A list of columns as the fields of a struct."""
    return ", ".join(":".join(x.split(" ", 1)) for x in ddl.split(", "))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows of conversations: conv_id, place, edit, role, text, and a report at place 0 of each.

    rows: conv_id, turn, role and text; `copy` orders equal rows, and rows whose `present` is false only name their
    conversation. Report: gaps, blank, duplicate, truncated, illegal, cost and audit. Rows of one turn go by a hash of
    role and text; null turns come first. A null conv_id is a conversation of its own, null roles and texts are one
    space, and an empty role has no initial that could be kept. A conversation without rows has zeros and an empty
    audit. Repeated rows are duplicates; extra columns are ignored; an empty table gives no rows.

    The search holds BLOCK rows; a conversation's audit is one string. Texts stream by in order, those of one
    conversation in one task, as one running hash over all of them needs.
    """
    full = ordered(in_batches(rows))
    parts = written(stretches(full))
    kinds = dict(full.dtypes)
    texts = full.filter(F.col("fault") != ABSENT).select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), *PLACE, "role", "text")
    both = parts.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    schema = f"conv_id {kinds['conv_id']}, place long, report struct<{_nested(SUMMARY)}>, edit string, role string, text string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from _in_batches(_applied(_records(batches)), arrow)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", *PLACE).mapInArrow(run, schema)


def _applied(records: Iterator[dict]) -> Iterator[dict]:
    """Fragments and then rows of each conversation become a report and then repaired rows."""
    key, fragments, state, at, place, audit = object(), [], START, 0, 0, None

    def inserts():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role = TURN_OF[state]
            at, place, state = at + 1, place + 1, NEXT[state, role[0]]
            yield {"conv_id": key, "place": place, "edit": "I", "role": role, "text": ""}

    def told():
        nonlocal audit
        if audit is None and fragments:
            report = summary(fragments)
            audit = report["audit"]
            yield {"conv_id": key, "place": 0, "report": report}
            yield from inserts()

    for r in records:
        if r["conv_id"] != key:
            yield from told()
            key, fragments, state, at, place, audit = r["conv_id"], [], START, 0, 0, None
        if r["kind"] == 0:
            fragments.append(r["fragment"])
            continue
        yield from told()
        letter, at = audit[at], at + 1
        if letter != "D":
            role = r["role"] if letter == "K" else TURN_OF[state]
            state, place = NEXT[state, role[:1]], place + 1
            yield {"conv_id": key, "place": place, "edit": letter, "role": role, "text": r["text"]}
        yield from inserts()
    yield from told()


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation, report and hash of its `role:text` lines, as the rows of `repair` stream by."""
    schema = f"conv_id {dict(repaired.dtypes)['conv_id']}, {SUMMARY}, repaired_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def found():
            report, digest = None, None
            for r in _records(batches):
                if r["place"] == 0:
                    if report:
                        yield report | {"repaired_sha256": digest.hexdigest()}
                    report, digest = {"conv_id": r["conv_id"]} | r["report"], hashlib.sha256()
                    continue
                digest.update(f"{chr(10) if r['place'] > 1 else ''}{r['role']}:{r['text']}".encode())
            if report:
                yield report | {"repaired_sha256": digest.hexdigest()}

        yield from _in_batches(found(), arrow)

    return repaired.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults made by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (present is false), 1 empties its text, 2 takes the full stops out, 3 repeats it, 4 makes it the
    user's. Nulls are one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20))
    drawn = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy"))


def op12_conversation_repair(spark, sf_dir):
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS c,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM base, tab),
hurt AS (
  SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds),
placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS i FROM hurt),
told AS (
  SELECT c, i, turn, role, text, role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) AS prior,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM placed),
-- States 0 to 3: nothing yet, after s, after u, after a. Up to three inserted rows lead on from a state.
inserts(q, q1, ins, icost, ilines) AS (VALUES
  (0, 0, '', 0, CAST([] AS VARCHAR[])), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
  (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:']),
  (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])),
edits(q1, letter, need, q2, ecost, named) AS (VALUES
  (0, 'D', '', 0, 2, ''), (1, 'D', '', 1, 2, ''), (2, 'D', '', 2, 2, ''), (3, 'D', '', 3, 2, ''),
  (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
  (0, 'R', '', 2, 1, 'user'), (1, 'R', '', 2, 1, 'user'), (2, 'R', '', 3, 1, 'assistant'), (3, 'R', '', 2, 1, 'user')),
ways(c, i, q, cost, audit, lines) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM base
  UNION ALL
  SELECT c, i, q2, cost, audit, lines FROM (
    SELECT w.c, r.i, e.q2, w.cost + n.icost + e.ecost + CASE WHEN e.letter <> 'D' AND r.fault = 3 THEN 5 ELSE 0 END AS cost, w.audit || n.ins || e.letter AS audit,
           list_concat(list_concat(w.lines, n.ilines), CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.named || ':' || r.text] END) AS lines
    FROM ways w JOIN told r ON r.c = w.c AND r.i = w.i + 1 JOIN inserts n ON n.q = w.q
    JOIN edits e ON e.q1 = n.q1 AND (e.letter = 'D' OR r.fault IN (0, 3)) AND (e.letter <> 'K' OR e.need = r.ini))
  QUALIFY row_number() OVER (PARTITION BY c, q2 ORDER BY cost, audit) = 1),
sizes AS (SELECT c, count(*) AS n, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps,
                 count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                 count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY c),
ids AS (SELECT DISTINCT c, conv_id FROM base),
ends AS (
  SELECT w.c, w.cost + n.icost AS cost, w.audit || n.ins AS audit, list_concat(w.lines, n.ilines) AS lines
  FROM ways w LEFT JOIN sizes s ON s.c = w.c JOIN inserts n ON n.q = w.q AND n.q1 IN (0, 3) WHERE w.i = coalesce(s.n, 0)
  QUALIFY row_number() OVER (PARTITION BY w.c ORDER BY w.cost + n.icost, w.audit || n.ins) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ids JOIN ends USING (c) LEFT JOIN sizes USING (c)
"""
