"""Conversation structure repair: shortest edits by the auction algorithm on a lattice of turns and states."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import crc32_sql, stored

#: States: nothing yet, after the system turn, after a user's, after an assistant's; END accepts the first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state behind a turn that is put in or takes another role, which each state allows one of, and that role.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: What it costs to end in each state, and the edits that do so.
END, LAST = (0, 6, 3, 0), ("", "II", "I", "")
NEVER = 1 << 40
#: Rows of a lattice that one auction prices; a segment is priced lattice by lattice from its end.
LATTICE = 64
#: Rows and characters from which on a conversation goes on in another segment.
SEGMENT_ROWS, SEGMENT_CHARS = 512, 4_000_000
SOLID, ENDED = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies``: rows with faults by the hash of ``conv_id:turn``; ``copies`` is 0 for dropped rows, 2 for repeated ones."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv, F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


# ---- one lattice


def faults(rows: list[dict], firsts: set[int] | None = None) -> list[str]:
    """The first fault of each row. ``firsts``: rows that are the first of their role and text; without it, the rows are a whole conversation."""
    seen: set[tuple[str, str]] = set()
    out = []
    for i, r in enumerate(rows):
        key = (r["role"], r["text"])
        again = key in seen if firsts is None else i not in firsts
        seen.add(key)
        out.append(BLANK if not SOLID.search(r["text"]) else DUPLICATE if again else "" if ENDED.search(r["text"]) else TRUNCATED)
    return out


def arcs_of(turns: list[tuple[str, str]], exits: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, to) of each node of a lattice, in the order of their letters; dead nodes have none.

    Node ``4 * i + q`` is state ``q`` before turn ``i``; the last node is the sink, at ``exits[q]`` from the states behind the last turn.
    """
    n, sink = len(turns), 4 * len(turns) + 4
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
    alive = [False] * sink + [True]
    for q in range(4):
        if exits[q] < NEVER:
            arcs[4 * n + q].append(("", exits[q], sink))
            alive[4 * n + q] = True
    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        more = CUT if fault == TRUNCATED else 0
        here, there = 4 * i, 4 * i + 4
        own = []
        for q in range(4):
            out = [("D", DELETE, there + q)]
            if fault not in (BLANK, DUPLICATE):
                if (to := NEXT.get((q, initial))) is not None:
                    out.append(("K", more, there + to))
                out.append(("R", REROLE + more, there + AFTER[q]))
            own.append([a for a in out if alive[a[2]]])
            alive[here + q] = bool(own[q])
        # Turns put in lead from state to state before the row; a second look sees what the first one brought to life.
        for _ in range(2):
            for q in range(4):
                alive[here + q] = alive[here + q] or alive[here + AFTER[q]]
        for q in range(4):
            put = [("I", INSERT, here + AFTER[q])] if alive[here + AFTER[q]] else []
            arcs[here + q] = sorted(own[q] + put)
    return arcs


def first_prices(turns: list[tuple[str, str]], exits: tuple[int, ...]) -> list[int]:
    """Prices that no arc undercuts: what each turn behind a node costs at least, and the cheapest exit."""
    least = min(exits)
    prices = [least] * 4
    for initial, fault in reversed(turns):
        least += DELETE if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0 if initial in ("s", "u", "a") else REROLE
        prices += [least] * 4
    return prices[::-1] + [0]


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> None:
    """Raise ``price`` until that of ``origin`` is its distance to the sink.

    A path grows from the origin: at its end, if every arc costs more than the node's price, the price rises to the cheapest one and
    the path loses the node; else the path goes on along that arc. Prices never undercut an arc, so at the sink they are distances.
    """
    sink, path = len(arcs) - 1, [origin]
    while (node := path[-1]) != sink:
        best, to = min((cost + price[to], to) for _, cost, to in arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def lattices(turns: list[tuple[str, str]], exits: tuple[int, ...]) -> tuple[list[tuple[list, list[int]]], tuple[int, ...]]:
    """(arcs, prices) of the lattices of a segment, first to last, and the distances of the states before it to the end."""
    out = []
    for at in range((len(turns) - 1) // LATTICE * LATTICE, -1, -LATTICE):
        own = turns[at : at + LATTICE]
        arcs, price = arcs_of(own, exits), first_prices(own, exits)
        for q in range(4):
            if arcs[q]:
                auction(arcs, price, q)
        out.append((arcs, price))
        exits = tuple(price[q] if arcs[q] else NEVER for q in range(4))
    return out[::-1], exits


def trace(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> tuple[str, int]:
    """The least audit in the order of letters among shortest paths, and the state in which it ends.

    Every shortest path is made of tight arcs (price = cost + next price); a tight arc may also lead where no path goes on, which
    is left by going back, and not tried again.
    """
    sink, dead = len(arcs) - 1, set()
    path, audit = [(origin, iter(arcs[origin]))], []
    while True:
        node, ahead = path[-1]
        for edit, cost, to in ahead:
            if price[node] == cost + price[to] and to not in dead:
                if to == sink:
                    return "".join(audit), node % 4
                path.append((to, iter(arcs[to])))
                audit.append(edit)
                break
        else:
            dead.add(node)
            path.pop()
            audit.pop()


def traced(parts: list[tuple[list, list[int]]], state: int) -> tuple[str, int]:
    audit = []
    for arcs, price in parts:
        own, state = trace(arcs, price, state)
        audit.append(own)
    return "".join(audit), state


# ---- segments and conversations


def turns_of(rows: list[dict], found: list[str]) -> list[tuple[str, str]]:
    return [(r["role"][:1], f) for r, f in zip(rows, found, strict=True)]


class Tally:
    """What is known of a conversation after some of its segments; nothing but the audit grows with it."""

    def __init__(self) -> None:
        self.state, self.initial, self.turn, self.low, self.turns = EMPTY, None, None, None, 0
        self.found = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.cost = self.rows = 0
        self.audit: list[str] = []
        self.digest, self.written = hashlib.sha256(), False

    def write(self, line: str) -> None:
        self.digest.update(("\n" + line if self.written else line).encode())
        self.written = True

    def insert(self) -> None:
        self.state = AFTER[self.state]
        self.cost += INSERT
        self.write(ROLE[self.state] + ":")

    def add(self, rows: list[dict], found: list[str], audit: str) -> None:
        at = 0
        for edit in audit:
            if edit == "I":
                self.insert()
                continue
            row, fault = rows[at], found[at]
            at += 1
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += CUT if fault == TRUNCATED else 0
            if edit == "K":
                self.state = NEXT[self.state, row["role"][:1]]
                self.write(f"{row['role']}:{row['text']}")
            else:
                self.state = AFTER[self.state]
                self.cost += REROLE
                self.write(f"{ROLE[self.state]}:{row['text']}")
        for row, fault in zip(rows, found, strict=True):
            if fault:
                self.found[fault] += 1
            initial, turn = row["role"][:1], row["turn"]
            self.illegal += self.initial is not None and self.initial + initial not in LEGAL
            self.initial = initial
            if turn is not None:  # in order
                self.turns += turn != self.turn
                self.low = turn if self.low is None else self.low
                self.turn = turn
        self.rows += len(rows)
        self.audit.append(audit)

    def result(self, conv: str | None) -> dict:
        if self.rows:
            self.audit.append(LAST[self.state])
            for _ in LAST[self.state]:
                self.insert()
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return {
            "conv": conv, "gaps": gaps, "blank": self.found[BLANK], "duplicate": self.found[DUPLICATE], "truncated": self.found[TRUNCATED],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


def repair_rows(rows: list[dict], conv: str | None = None) -> dict:
    """The report on one whole conversation: dicts of ``turn, role, text`` in order."""
    found, tally = faults(rows), Tally()
    if rows:
        parts, _ = lattices(turns_of(rows, found), END)
        tally.add(rows, found, traced(parts, EMPTY)[0])
    return tally.result(conv)


ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
SEGMENT = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("whole", pa.bool_()), ("rows", ROWS)])
SEGMENT_DDL = "conv string, seg long, whole boolean, rows array<struct<turn:long,role:string,text:string>>"


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Record batches of ``most`` rows or of some millions of characters."""
    out, chars = [], 0
    for r in rows:
        out.append(r)
        chars += sum(len(x["text"]) for x in r.get("rows") or ())
        if len(out) >= most or chars >= SEGMENT_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments. ``whole``: the conversation is this segment alone, as others lie before and behind it in the partition."""
    number = TaskContext.get().partitionId() << 32

    def segments():
        nonlocal number
        conv, rows, chars, pieces, convs, began = None, [], 0, 0, 0, False
        for r in _rows(batches):
            new = began and r["conv"] != conv
            if new or len(rows) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
                yield {"conv": conv, "seg": number, "whole": new and pieces == 0 and convs > 0, "rows": rows}
                number += 1
                rows, chars, pieces, convs = [], 0, 0 if new else pieces + 1, convs + new
            began, conv = True, r["conv"]
            rows += [{k: r[k] for k in ("turn", "role", "text")}] * r["copies"]
            chars += len(r["text"])
        if began:
            yield {"conv": conv, "seg": number, "whole": False, "rows": rows}

    yield from _batched(segments(), SEGMENT)


def segments(rows: DataFrame) -> DataFrame:
    """Segments of conversations in order, ``seg`` rising along each; a conversation of any size is dealt over many tasks."""
    digest = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    keyed = rows.withColumns({"digest": digest, "place": F.monotonically_increasing_id()})
    order = ["conv", "turn", "digest", "place"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "copies").mapInArrow(_cut, SEGMENT_DDL)


REPORT = pa.schema([("conv", pa.string()), *[(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FIELDS.split(", ")]])


def _repair_whole(batches):
    yield from _batched((repair_rows(r["rows"], r["conv"]) for r in _rows(batches)), REPORT)


def _price(batches):
    """For each segment, the distance from each state before it to each state behind it: 16 numbers."""

    def priced():
        for r in _rows(batches):
            turns = turns_of(r["rows"], faults(r["rows"], set(r["firsts"] or ())))
            ways = [[0 if q == to else NEVER for q in range(4)] for to in range(4)]
            costs = [lattices(turns, tuple(w))[1] if turns else tuple(w) for w in ways]
            yield {"conv": r["conv"], "seg": r["seg"], "costs": [costs[to][q] for q in range(4) for to in range(4)]}

    yield from _batched(priced(), pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _exits(batches):
    """Segments of each conversation from last to first: what the end costs from each state behind the segment."""

    def passed():
        conv, exits, began = None, END, False
        for r in _rows(batches):
            if not began or r["conv"] != conv:
                began, conv, exits = True, r["conv"], END
            yield {"seg": r["seg"], "exits": list(exits)}
            c = r["costs"]
            exits = tuple(min(NEVER, min(c[4 * q + to] + exits[to] for to in range(4))) for q in range(4))

    yield from _batched(passed(), pa.schema([("seg", pa.int64()), ("exits", pa.list_(pa.int64()))]))


def _trace(batches):
    """For each segment the audit from every state before it, so that no segment waits for another."""

    def done():
        for r in _rows(batches):
            found = faults(r["rows"], set(r["firsts"] or ()))
            audits = [""] * 4
            if r["rows"]:
                parts, before = lattices(turns_of(r["rows"], found), tuple(r["exits"]))
                audits = [traced(parts, q)[0] if before[q] < NEVER else None for q in range(4)]
            yield {k: r[k] for k in ("conv", "seg", "rows")} | {"found": found, "audits": audits}

    yield from _batched(done(), pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("rows", ROWS), ("found", pa.list_(pa.string())), ("audits", pa.list_(pa.string()))]))


def _join_up(batches):
    """Segments of each conversation from first to last: the report, with the text hashed as it passes."""

    def done():
        conv, tally = None, None
        for r in _rows(batches):
            if tally is None or r["conv"] != conv:
                if tally:
                    yield tally.result(conv)
                conv, tally = r["conv"], Tally()
            tally.add(r["rows"], r["found"], r["audits"][tally.state])
        if tally:
            yield tally.result(conv)

    yield from _batched(done(), REPORT)


def _repair_long(parts: DataFrame) -> DataFrame:
    """Reports on conversations of several segments: priced apart, tied at their ends, traced apart, joined in order."""
    turn = F.posexplode("rows").alias("i", "r")
    each = parts.select("conv", "seg", turn).select("conv", "seg", "i", F.sha2(F.concat("r.role", F.lit("\0"), "r.text"), 256).alias("digest"))
    first = each.groupBy("conv", "digest").agg(F.min(F.struct("seg", "i")).alias("at"))
    firsts = first.groupBy(F.col("at.seg").alias("of")).agg(F.collect_list("at.i").alias("firsts"))
    parts = stored(parts.join(firsts.hint("merge"), parts["seg"] == firsts["of"], "left").drop("of"), "long_segments")
    priced = parts.select("conv", "seg", "rows", "firsts").mapInArrow(_price, "conv string, seg long, costs array<long>")
    exits = priced.repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(_exits, "seg long, exits array<long>")
    exits = stored(exits, "exits")
    traced_ = parts.join(exits.hint("merge"), "seg").mapInArrow(_trace, "conv string, seg long, rows array<struct<turn:long,role:string,text:string>>, found array<string>, audits array<string>")
    return traced_.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_join_up, f"conv string, {FIELDS}")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of damaged rows: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows of a conversation stand by turn (null first), those of one turn by the hash of role and text. Null role and text are one
    space; a null ``conv_id`` is a conversation of its own, with a space in the key of its faults. Empty texts are blank, long ones are
    read whole, repeated rows are duplicates, and extra columns are left out. A conversation without rows left has zeros; an empty
    table gives an empty result. Conversations of many rows are dealt over tasks; only the hash of the repaired text and the audit,
    which are one value each, pass through one task in segments.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    cut = stored(segments(damaged(rows)), "segments")
    whole = cut.where("whole").select("conv", "rows").mapInArrow(_repair_whole, f"conv string, {FIELDS}")
    found = whole.unionByName(_repair_long(cut.where("NOT whole")))
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *[f.split()[0] for f in FIELDS.split(", ")])


def _edit(state: str, letter: str, cost: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _oracle() -> str:
    """The edits by dynamic programming forward over (cost, audit, text), without any lattice."""
    put = lambda q, role: _edit(q, "I", "3", f"chr(10) || '{role}:'")
    keep = lambda q, initial: f"CASE WHEN ok AND left(role, 1) = '{initial}' THEN {_edit(q, 'K', 'more', 'chr(10) || role || chr(58) || text')} END"
    turn = lambda q, role: f"CASE WHEN ok THEN {_edit(q, 'R', '(3 + more)', f"chr(10) || '{role}:' || text")} END"
    drop = lambda q: _edit(q, "D", "4")
    user, assistant = _least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user")), _least("s3", put("u2", "assistant"))
    steps = {
        "n0": drop("s0"),
        "n1": _least(drop("s1"), keep("s0", "s")),
        "n2": _least(drop("u2"), *[f(q, x) for q in ("s0", "s1", "u3") for f, x in ((keep, "u"), (turn, "user"))]),
        "n3": _least(drop("u3"), keep("u2", "a"), turn("u2", "assistant")),
    }
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
    WITH RECURSIVE hit AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM hit),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(role, chr(0), text))) AS i,
               NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank
        FROM damaged),
    marked AS (
        SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_duplicate,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed),
    rows AS (
        SELECT *, NOT is_blank AND NOT is_duplicate AS ok, NOT is_blank AND NOT is_duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut
        FROM marked),
    walk(conv_id, i, s0, s1, s2, s3) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}::{state}, NULL::{state}, NULL::{state}, NULL::{state} FROM conversations
        UNION ALL
        SELECT conv_id, i, {", ".join(f"{x}::{state}" for x in steps.values())}
        FROM (SELECT *, {assistant} AS u3 FROM (
            SELECT r.conv_id, r.i, role, text, ok, CASE WHEN is_cut THEN 3 ELSE 0 END AS more, s0, s1, s3, {user} AS u2
            FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
    last AS (SELECT conv_id, max(i) AS i FROM walk GROUP BY conv_id),
    ends AS (
        SELECT conv_id, {_least("s0", assistant)} AS best
        FROM (SELECT w.*, {user} AS u2 FROM walk w JOIN last l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i)),
    facts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(is_blank) AS blank, count_if(is_duplicate) AS duplicate,
               count_if(is_cut) AS truncated, count_if(before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
           sha256(substr(best.t, 2)) AS repaired_sha256
    FROM ends e LEFT JOIN facts f ON e.conv_id IS NOT DISTINCT FROM f.conv_id"""


ORACLE = _oracle()


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
