"""Conversation repair against plain versions, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from filmstrip.llm import queries, repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute_edits(symbols):
    """The least (cost, audit) by trying all edits, with up to three inserts in a row."""
    best, n = None, len(symbols)

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == n and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 3:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", inserts + 1)
        if i < n:
            must, cut, role = symbols[i][0] == "!", symbols[i][0] == "~", symbols[i][-1]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not must:
                if role in "sua":
                    go(i + 1, roles + role, cost + cut, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_parser_and_parts():
    r = random.Random(0)
    for _ in range(600):
        n = r.randint(0, 6)
        symbols = [r.choice(["", "", "", "!", "~"]) + r.choice("suuaa ") for _ in range(n)]
        want = brute_edits(symbols)
        assert repair.repair(repair.parse(symbols)) == want
        a = r.randint(0, n)
        b = r.randint(a, n)
        chart = repair.parse(symbols[:a])
        for part in (symbols[a:b], symbols[b:]):
            chart = repair.joined(chart, {i: repair.parse(part, i) for i in repair.ITEMS})
        assert repair.repair(chart) == want


def by_parts(symbols, rows=40):
    chart = repair.parse(symbols[:rows])
    for k in range(rows, len(symbols), rows):
        chart = repair.joined(chart, {i: repair.parse(symbols[k : k + rows], i) for i in repair.ITEMS})
    return repair.repair(chart)


def hashed(spark, rows):
    """The hash that orders rows of one turn."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "role string, text string")
    return {(x.role, x.text): x.h for x in df.select("role", "text", F.xxhash64("role", "text").alias("h")).collect()}


def plain(spark, turns):
    """The contract row by row."""
    space = lambda x: " " if x is None else str(x)
    convs = {c: [] for c, *_ in turns}
    for c, t, role, text in turns:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = hashed(spark, list({(r, x) for rows in convs.values() for _, r, x in rows} | {("", "")}))
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, order[r[1:]]))
        seen, symbols, blank, dup, cut = set(), [], 0, 0, 0
        for _, role, text in rows:
            end = text.rstrip(SPACE)
            faults = (not end, (role, text) in seen, end[-1:] not in tuple(".!?"))
            blank, dup, cut = blank + faults[0], dup + (faults[1] and not faults[0]), cut + (faults == (False, False, True))
            seen.add((role, text))
            symbols.append(("!" if faults[0] or faults[1] else "~" if faults[2] else "") + (role[:1] if role[:1] in ("s", "u", "a") else " "))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        numbers = {t for t, *_ in rows if t is not None}
        cost, audit = by_parts(symbols) if len(symbols) > 9 else brute_edits(symbols)
        lines, todo = [], iter(rows)
        for e in audit:
            row = next(todo) if e != "I" else None
            if e == "D":
                continue
            after = lines[-1][0][:1] if lines else "a"
            due = "assistant" if after == "u" else "user"
            lines.append((row[1] if e == "K" else due, row[2] if row else ""))
        text = "\n".join(f"{a}:{b}" for a, b in lines)
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, blank, dup, cut, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_turns():
    r = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    texts = ["Yes.", "No!", "Why", "", " \t", None, "Yes.", "Well? ", "x\x0b", "é…", "long. " * 2000]
    rows = [(c, t, r.choice(roles[: r.choice([2, 3, 7])]), r.choice(texts)) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 5, "user", "a."), (101, None, None, None), (None, 1, "user", "Hi."), (None, 9, "assistant", "Ho."), (None, None, "system", "S.")]
    rows += [(102, t, ["user", "assistant"][t % 2 if t % 17 else 0], f"Turn {t % 90}{'.' if t % 5 else ''}") for t in range(400)]
    rows += [(103, 1, "user", "same.")] * 7 + [(104, t, "user", "same.") for t in range(6)] + [(105, t, "tool", "x.") for t in range(5)]
    return rows


@pytest.mark.parametrize("options", [{}, {"part_rows": 3}, {"part_rows": 7, "part_chars": 100}])
def test_repair(spark, options):
    df = spark.createDataFrame(odd_turns(), TURNS).selectExpr("*", "1 as key", "2 as said", "'x' as cut", "3 as conv").repartition(3)
    got = repair.repaired(df, **options).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(spark, odd_turns()) and len(got) == len({c for c, *_ in odd_turns()})


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(3000) if t % 100 != 50]
    want = plain(spark, rows)
    got = repair.repaired(spark.createDataFrame(rows, TURNS)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(want[7][6]) > 2700


def test_given_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (2, 0, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repaired(df, df.withColumnRenamed("conv_id", "conv")).collect()}
    assert got == {1: (0, "KK"), 2: (2, "IK")}
    assert repair.repaired(df.limit(0)).count() == 0
    assert {tuple(r)[1:8] for r in repair.repaired(df, df.withColumnRenamed("conv_id", "conv").limit(0)).collect()} == {(0, 0, 0, 0, 0, 0, "")}


@pytest.mark.parametrize("name", ["op11_negatives", "op12_repair"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(r.fetchall())


def test_repair_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op12_repair(spark, SF).collect()} == plain(spark, turns)
