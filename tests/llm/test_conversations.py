"""Conversation repair against a plain search over all edits, and against SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm import conversations
from glyphlake.llm.common import crc32_sql
from tests.llm.conftest import LONG

ROW = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) by a search in the order of (cost, audit)."""
    seen, faults = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if blank else "again" if (role, text) in seen else "cut" if re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    good = re.compile(r"(s?(ua)+)?\Z")
    start = re.compile(r"s?(ua)*u?\Z")
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and good.match(roles):
            return cost, audit, lines
        if (at, state := (roles[:1] == "s" and len(roles) == 1, len(roles) == 0, roles[-1:])) in done:
            continue
        done.add((at, state))

        def step(letter, more, at, role, line):
            if start.match(roles + role):
                heapq.heappush(heap, (cost + more, audit + letter, at, roles + role, lines + line))

        for role in ("user", "assistant"):
            step("I", 3, at, role[0], (f"{role}:",))
        if at < len(rows):
            role, text = rows[at]
            more = 3 if faults[at] == "cut" else 0
            step("D", 4, at + 1, "", ())
            if faults[at] in ("", "cut"):
                if role[:1] in ("s", "u", "a"):
                    step("K", more, at + 1, role[0], (f"{role}:{text}",))
                for other in ("user", "assistant"):
                    step("R", 3 + more, at + 1, other[0], (f"{other}:{text}",))


texts = st.sampled_from(["Hi.", "Oh", "", " \n", "Why?", "No!  ", "é", "Fine."])
roles = st.sampled_from(["user", "assistant", "system", "tool", "", " ", "u"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=9))
def test_auction_finds_the_cheapest_least_audit(rows):
    cost, audit, lines = cheapest(rows)
    found = conversations.repair_rows([{"turn": i, "role": r, "text": t} for i, (r, t) in enumerate(rows)])
    assert (found["cost"], found["audit"]) == (cost, audit)
    assert found["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(roles, texts), min_size=1, max_size=12), st.permutations(range(4)))
def test_prices_are_distances_that_no_arc_undercuts(rows, order):
    found = conversations.faults([{"role": r, "text": t} for r, t in rows])
    turns = [(r[:1], f) for (r, _), f in zip(rows, found, strict=True)]
    arcs, price = conversations.arcs_of(turns, conversations.END), conversations.first_prices(turns, conversations.END)
    far = [0] * len(arcs)
    for node in range(4 * len(turns) + 3, -1, -1):
        far[node] = conversations.NEVER
    for _ in range(4):
        for node in range(len(far) - 2, -1, -1):
            far[node] = min([far[node], *[c + far[to] for _, c, to in arcs[node]]])
    for q in order:
        conversations.auction(arcs, price, q)
        assert all(price[n] <= c + price[to] for n in range(len(arcs)) for _, c, to in arcs[n])
    assert price[:4] == far[:4]


def fault_of(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def expected(rows):
    """Reports on damaged rows, by conversation."""
    own = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = fault_of(conv, turn)
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own.setdefault(conv, []).extend([(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    out = {}
    for conv, found in own.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        kinds = conversations.faults([{"role": r, "text": t} for _, r, t in found])
        turns = {t for t, _, _ in found if t is not None}
        cost, audit, lines = cheapest([r[1:] for r in found])
        initials = [r[:1] for _, r, _ in found]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(kinds.count(k) for k in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_all_rows_and_edges(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (-1, None, "user", "A."), (-1, None, "assistant", "B."), (-1, 7, "user", "A."), (-2, 1, "user", LONG), (-2, 1, "user", LONG), (-2, 5, "assistant", ""), (-3, 0, "", "x")]
    gone = next(i for i in range(10**6, 10**7) if fault_of(i, 0) == 0)
    rows.append((gone, 0, "user", "All of it."))
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW + ", seg string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df).collect()}
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_of_many_rows_is_cut_and_tied(spark):
    draw = random.Random(5)
    said = ["Yes.", "No", "", "Why?", "So it is!"] + [f"Number {i}." for i in range(700)] + [f"Half {i}" for i in range(200)]
    rows = [(1, i, draw.choice(["user", "assistant", "assistant", "user", "system", "tool"]), draw.choice(said)) for i in range(1800)]
    rows += [(2, i, "user", "The same.") for i in range(700)] + [(3, 0, "user", "Hi."), (3, 1, "assistant", "Hello.")]
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, ROW)).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    assert conversations.repair(spark.createDataFrame([], ROW)).collect() == []


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    frame = conversations.op11_conversation_repair(spark, sf_dir)
    ours = {tuple(r) for r in frame.collect()}
    assert ours == set(con.execute(conversations.ORACLE).df()[frame.columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("text", ["0:0", "123:4", " : ", "-5:12345"])
def test_crc32_in_sql(text):
    assert duckdb.execute(f"SELECT {crc32_sql(chr(39) + text + chr(39))}").fetchone()[0] == zlib.crc32(text.encode())
