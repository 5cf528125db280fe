"""Repair of a conversation's structure by the cheapest edits: an optional system turn, then pairs of user and assistant.

The rows of a conversation come by turn (nulls first), those of one turn by role and the MD5 of their text. A row is blank
(no character but ASCII white space), else a duplicate (its role and text stood earlier in the conversation), else
truncated (its last such character is no end of a sentence), else sound. Edits keep a row, change its role, delete it or insert
an empty turn before it; their initials are the audit. Of the cheapest audits the ASCII-least is taken.

Before and after each row a conversation is in one of four states: nothing yet, after system, after user, after assistant. Costs from
the first row forward and from the last one backward meet in the middle; of the states in which the two sum to the
least the one with the least audit before it is the crossing, and either half is solved in the same way. A row's part of an audit is
inserts and one other edit, so no part is the beginning of another, and audits over the same rows compare
part by part: the ranks of the four states are all that has to be known of them. So a task holds a byte for each row
of the conversation at hand, its audit, and two vectors of four.

Texts travel once: audits of all conversations, made from rows without texts, go ahead of the rows that they edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, pick, written

#: The states, and where an inserted or changed turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
#: The costs of a changed role, a deletion, an insertion, and of a truncated row that stays.
ROLE, DELETE, INSERT, STAYS = 3, 4, 3, 3
#: A row is a number: its role's initial (s, u, a, other) and its fault; the end of a conversation is one more.
SOUND, REMOVED, TRUNCATED, END = 0, 4, 8, 12
FAR = 1 << 60
#: From any state the rest costs at most so much more than from another, so costs that lie further above the least lead nowhere.
APART = 32
#: The conversations whose audits a worker keeps, and the longest of them.
KEPT, SHORT = 100_000, 64
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _steps(row: int) -> list[list[tuple[int, str, int]]]:
    """For each state the (cost, part of the audit, next state) of the ways over a row; two inserts lead anywhere that any number leads to."""
    out = []
    for state in range(4):
        ways, now = [], state
        for k in range(3):
            cost, some = INSERT * k, "I" * k
            if row == END:
                if now in (START, ASSISTANT):
                    ways.append((cost, some, START))
            else:
                ways.append((cost + DELETE, some + "D", now))
                initial, fault = row % 4, row - row % 4
                stays = STAYS if fault == TRUNCATED else 0
                if fault != REMOVED:
                    to = SYSTEM if initial == 0 and now == START else AFTER[now] if initial == AFTER[now] - 1 else None
                    if to is not None:
                        ways.append((cost + stays, some + "K", to))
                    ways.append((cost + stays + ROLE, some + "R", AFTER[now]))
            now = AFTER[now]
        out.append(ways)
    return out


STEPS = [_steps(row) for row in range(END + 1)]


@lru_cache(maxsize=1 << 16)
def _onward(costs: tuple[int, ...], ranks: tuple[int, ...], row: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The least cost so far, and each state's cost beyond it and its audit's rank, after one more row."""
    best = [(FAR, 0, "")] * 4
    for state in range(4):
        if costs[state] < FAR:
            for cost, part, to in STEPS[row][state]:
                best[to] = min(best[to], (costs[state] + cost, ranks[state], part))
    order = sorted((b[1:], s) for s, b in enumerate(best) if b[0] < FAR)
    place = {s: k for k, (_, s) in enumerate(order)}
    least = min(b[0] for b in best)
    return least, tuple(b[0] - least if b[0] - least <= APART else FAR for b in best), tuple(place.get(s, 0) for s in range(4))


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple[int, ...], row: int) -> tuple[int, ...]:
    """What each state before a row costs up to the end, beyond the least of them."""
    found = [min((cost + costs[to] for cost, _, to in STEPS[row][state]), default=FAR) for state in range(4)]
    least = min(found)
    return tuple(c - least if c < FAR else FAR for c in found)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else FAR for s in range(4))


def _audit(rows: bytes) -> tuple[int, str]:
    """The least cost of a conversation's rows and its least audit."""
    rows += bytes([END])
    total, costs, ranks = 0, _only(START), (0,) * 4
    for row in rows:
        more, costs, ranks = _onward(costs, ranks, row)
        total += more
    parts: list[str] = []
    todo = [(0, len(rows), START, START)]
    while todo:
        low, high, come, go = todo.pop()
        if high - low == 1:
            parts.append(min(w for w in STEPS[rows[low]][come] if w[2] == go)[1])
            continue
        middle = (low + high) // 2
        ahead, ranks = _only(come), (0,) * 4
        for row in rows[low:middle]:
            _, ahead, ranks = _onward(ahead, ranks, row)
        back = _only(go)
        for row in reversed(rows[middle:high]):
            back = _backward(back, row)
        _, _, state = min((min(ahead[s] + back[s], FAR), ranks[s], s) for s in range(4))
        todo += [(middle, high, state, go), (low, middle, come, state)]
    return total, "".join(parts)


_kept = lru_cache(maxsize=KEPT)(_audit)


def audit(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows: each a byte, the initial of its role (0 s, 1 u, 2 a, 3 other) and SOUND, REMOVED or TRUNCATED."""
    return (_kept if len(rows) <= SHORT else _audit)(rows)


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """The (begin, end) of each run of equal ids."""
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True)) if len(ids) else []


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of AUDITS for each conversation of rows (conv_id, turn, row, fault), which come by conversation and turn."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [x.split()[0] for x in AUDITS.split(", ")]
    now, rows, faults, turns = None, bytearray(), np.zeros(4, np.int64), (None, None, 0)

    def told() -> tuple:
        cost, text = audit(bytes(rows))
        first, last, several = turns
        initial = np.frombuffer(rows, np.uint8) & 3
        a, b = initial[:-1], initial[1:]
        legal = (b == 1) & (a != 1) & (a != 3) | (a == 1) & (b == 2)
        return now, last - first + 1 - several if several else 0, *faults[1:].tolist(), int((~legal).sum()), cost, text

    for batch in batches:
        ids, own, fault = (batch.column(c).to_numpy() for c in ("conv_id", "row", "fault"))
        known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy()
        out = []
        for low, high in _runs(ids):
            if ids[low] != now:
                if now is not None:
                    out.append(told())
                now, rows, faults, turns = int(ids[low]), bytearray(), np.zeros(4, np.int64), (None, None, 0)
            rows += own[low:high].astype(np.uint8).tobytes()
            faults += np.bincount(fault[low:high], minlength=4)
            some = turn[low:high][known[low:high]]
            if len(some):
                first, last, several = turns
                several += int((some[1:] != some[:-1]).sum()) + int(last is None or last != some[0])
                turns = int(some[0]) if first is None else first, int(some[-1]), several
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(told(), kinds, strict=True)], names=names)


def _rows(conversations: DataFrame) -> DataFrame:
    return pick(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id IS NOT NULL").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})


def _by_turn() -> list[Column]:
    return [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("mark")]


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    gaps counts the turns that lack between the first and the last, illegal the neighbours whose roles can't be neighbours.
    Null roles and texts count as one space, rows without a conv_id as none; repeated rows are duplicates.
    """
    bare = F.translate("text", SPACE, "")
    rows = _rows(conversations).withColumn("mark", F.unhex(F.md5("text")))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    rows = rows.select("conv_id", "turn", "role", "mark", initial.alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "mark").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    rows = rows.withColumn("fault", fault)
    row = F.col("initial") + F.when(F.col("fault") == 3, TRUNCATED).when(F.col("fault") > 0, REMOVED).otherwise(SOUND)
    dealt = rows.withColumn("row", row).sortWithinPartitions(*_by_turn())
    return dealt.select("conv_id", "turn", F.col("row").cast("int").alias("row"), F.col("fault").cast("int").alias("fault")).mapInArrow(_audits, AUDITS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edited rows of conversations, whose audits come ahead of their rows: (conv_id, place, edit, role, text), and the audit's own at place 0."""
    names = ["conv_id", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    out: list[tuple] = []
    now, text, at, state, place = None, "", 0, START, 0

    def insert() -> None:
        nonlocal at, state, place
        while at < len(text) and text[at] == "I":
            state, place, at = AFTER[state], place + 1, at + 1
            out.append((now, place, "I", b"user" if state == USER else b"assistant", b""))

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=names)
        out.clear()
        return done

    for some in batches:
        ids, told, roles, texts = (some.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))
        for conv, own, role, body in zip(ids, told, roles, texts, strict=True):
            if own is not None:
                insert()  # at the end of the one before
                now, text, at, state, place = conv, own, 0, START, 0
                out.append((conv, 0, None, None, None))
                continue
            insert()
            edit, at = text[at], at + 1
            if edit == "D":
                continue
            state = SYSTEM if edit == "K" and role[:1] == b"s" else AFTER[state]
            place += 1
            out.append((conv, place, edit, role if edit == "K" else b"user" if state == USER else b"assistant", body))
        yield batch()
    insert()
    yield batch()


def _dealt(conversations: DataFrame, told: DataFrame) -> DataFrame:
    """Audits and rows of conversations together, each audit ahead of its rows."""
    rows = _rows(conversations).select("conv_id", "turn", F.unhex(F.md5("text")).alias("mark"), "role", "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("mark", "binary"), ("role", "string"), ("text", "string"))]
    both = told.select("conv_id", *none, "audit").unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.isnull("audit"), *_by_turn()[1:])
    both = both.select("conv_id", "audit", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    return both.mapInArrow(_edited, "conv_id long, place long, edit string, role binary, text binary")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, from place 1; conversations of which nothing stays have none.

    edit is K for kept rows, R for those with another role, I for inserted ones. Nulls and repeats as in audits().
    """
    rows = _dealt(conversations, audits(conversations)).filter("place > 0")
    return rows.select("conv_id", "place", "edit", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of edited rows as they come."""
    now, h = None, None
    for batch in batches:
        done = []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = conv, hashlib.sha256()
            else:
                h.update((b"\n" if place > 1 else b"") + role + b":" + text)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def digests(conversations: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of audits: the digest of each repaired conversation, `role:text` in lines."""
    return _dealt(conversations, told).mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends
    of sentences, 3 repeats it, 4 makes it the user's. Nulls become one space; rows without a conv_id go."""
    code = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = _rows(conversations).withColumn("code", code).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id of conversations, damaged and repaired.

    A conversation that loses all its rows has zeros, an empty audit and the digest of nothing; null conv_ids aren't any.
    """
    rows = damaged(conversations)
    told = written(audits(rows), "audits")  # two jobs read it
    found = told.join(digests(rows, told).withColumnRenamed("conv_id", "_id"), F.col("conv_id") == F.col("_id")).drop("_id").withColumnRenamed("conv_id", "_id")
    every = pick(conversations, conv_id="long").filter("conv_id IS NOT NULL").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return every.join(found, F.col("conv_id") == F.col("_id"), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The contract of repair_damaged over all conversations, for a check by SQL: all states' cheapest and least audits are carried from row to row."""
    far = 1_000_000
    ways: list[list[str]] = [[] for _ in range(4)]
    for state in range(4):
        to = state
        for k in range(3):
            cost, text = f"acc.s[{state + 1}].c + {INSERT * k}", f"acc.s[{state + 1}].a || '{'I' * k}"
            way = lambda at, when, more, edit, cost=cost, text=text: ways[at].append(f"{{'c': {cost} + CASE WHEN {when} THEN {more} ELSE {far} END, 'a': {text}{edit}'}}")
            stays = f"CASE WHEN x.f = 2 THEN {STAYS} ELSE 0 END"
            way(to, "x.f < 9", DELETE, "D")
            if to == START:
                way(SYSTEM, "x.f IN (0, 2) AND x.r = 0", stays, "K")
            way(AFTER[to], f"x.f IN (0, 2) AND x.r = {AFTER[to] - 1}", stays, "K")
            way(AFTER[to], "x.f IN (0, 2)", f"{ROLE} + {stays}", "R")
            if to in (START, ASSISTANT):
                way(START, "x.f = 9", 0, "")
            to = AFTER[to]
    step = "{'r': 0, 'f': 0, 's': [" + ", ".join(f"list_min([{', '.join(w)}])" for w in ways) + "]}"
    none = "CAST([] AS STRUCT(c INTEGER, a VARCHAR)[])"
    first = "{'r': 0, 'f': 0, 's': [" + ", ".join(f"{{'c': {0 if k == START else far}, 'a': ''}}" for k in range(4)) + "]}"
    crc = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), CAST(4294967295 AS BIGINT))"
    told = "CASE WHEN x.e = 'D' THEN acc.out WHEN x.e = 'K' THEN acc.out || chr(10) || x.role || ':' || x.text ELSE acc.out || chr(10) || CASE WHEN acc.st = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x.e = 'I' THEN '' ELSE x.text END END"
    state = "CASE WHEN x.e = 'D' THEN acc.st WHEN x.e = 'K' AND left(x.role, 1) = 's' THEN 1 WHEN acc.st = 2 THEN 3 ELSE 2 END"
    row = "len(replace(left(audit, CAST(i AS INTEGER)), 'I', '')) + 1"
    events = f"list_transform(range(len(audit)), lambda i: {{'e': substr(audit, CAST(i + 1 AS INTEGER), 1), 'role': coalesce(parts[{row}].role, ''), 'text': coalesce(parts[{row}].text, ''), 'st': 0, 'out': ''}})"
    return f"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS code FROM conversations, crc WHERE conv_id IS NOT NULL),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT * FROM coded WHERE code > 0 UNION ALL SELECT * FROM coded WHERE code = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM damaged),
faults AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM numbered),
convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (k > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text}} ORDER BY k) AS parts,
  list({{'r': r, 'f': CASE fault WHEN 'blank' THEN 1 WHEN 'duplicate' THEN 1 WHEN 'truncated' THEN 2 ELSE 0 END, 's': {none}}} ORDER BY k) AS rows FROM faults GROUP BY 1),
solved AS (SELECT *, list_reduce([{first}] || rows || [{{'r': 0, 'f': 9, 's': {none}}}], lambda acc, x: {step}).s[1] AS best FROM convs),
audits AS (SELECT *, best.a AS audit, CAST(best.c AS BIGINT) AS cost FROM solved),
texts AS (SELECT *, substr(list_reduce([{{'e': '', 'role': '', 'text': '', 'st': 0, 'out': ''}}] || {events}, lambda acc, x: {{'e': '', 'role': '', 'text': '', 'st': {state}, 'out': {told}}}).out, 2) AS repaired FROM audits)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM coded) LEFT JOIN texts USING (conv_id)"""


SQL = _sql()
