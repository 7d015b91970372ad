"""Valid-time enrichment against a plain loop over the contract's steps, with and without hot clients, and against its SQL."""

import datetime
import os
import random
import zlib

import duckdb

from datagauge.llm import validtime

DAY = datetime.datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, slot int"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double, note string"
COLUMNS = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]
HOLD = datetime.timedelta(hours=36)


def batch(at, extra=0):
    return 9 if at is None else max(0, min(9, ((at - datetime.datetime(1970, 1, 1)).days + extra - 19723) * 10 // 152))


def brute(sales, changes):
    least = -(1 << 63)
    changes = [c for c in dict.fromkeys(changes) if c[4] is not None]
    sold, moved = {}, {}
    for s in sales:
        sold.setdefault(batch(s[3]), []).append(s)
    for c in changes:
        moved.setdefault(9 if c[0] is None else batch(c[4], zlib.crc32(str(c[0]).encode()) % 4), []).append(c)
    versions, waiting, out, past = {}, [], [], [[], []]
    for b in range(11):
        marks = [max(p) - HOLD if p else None for p in past]
        h = datetime.datetime.max if b == 10 else None if None in marks else min(marks)
        for c in moved.get(b, []):
            if marks[1] is not None and c[4] < marks[1]:
                out.append(("late", c[0], b, None, None, None, None))
            else:
                versions.setdefault(c[1], []).append(c)
        order = lambda c: (c[4], least if c[2] is None else c[2], least if c[0] is None else c[0], least if c[5] is None else c[5], c[3] or "")
        now, waiting = waiting + sold.get(b, []), []
        for s in now:
            if s[2] is not None and (h is None or s[2] >= h):
                waiting.append(s)
                continue
            held = versions.get(s[1], []) if s[1] is not None else []
            found = max((c for c in held if s[2] is not None and c[4] <= s[2]), key=order, default=None)
            cents = None if found is None or found[5] is None else int(100 * found[5] + 0.5)
            out.append(("sale", s[0], b, len(held), found and found[0], cents, found and found[3]))
        if h is not None:
            for k, held in versions.items():
                old = [c for c in held if c[4] <= h]
                versions[k] = [c for c in held if c[4] > h] + ([max(old, key=order)] if old else [])
        past[0] += [s[2] for s in sold.get(b, []) if s[2] is not None]
        past[1] += [c[4] for c in moved.get(b, [])]
    return out


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def made(seed, n=700, last=125):
    """Skewed clients, ties, nulls, repeated rows, late changes and arrivals; times on a coarse grid, so that many are equal."""
    rng = random.Random(seed)
    client = lambda: None if rng.random() < 0.03 else 7 if rng.random() < 0.35 else rng.randrange(12)
    sales, changes = [], []
    for i in range(n):
        at = DAY + datetime.timedelta(hours=12 * rng.randrange(last * 2))
        arrived = None if rng.random() < 0.01 else at + datetime.timedelta(hours=rng.choice([0, 1, 30, 400, 1500]), minutes=rng.randrange(60), microseconds=rng.randrange(10**6))
        sales.append((None if i == 5 else i, client(), None if rng.random() < 0.03 else at, arrived, 1))
        at = DAY + datetime.timedelta(hours=12 * rng.randrange(last * 2))
        changes.append((i, client(), rng.choice([None, 0, 1, 2]), rng.choice([None, "I", "U", "D"]), None if rng.random() < 0.03 else at, None if rng.random() < 0.1 else rng.randrange(10**6) / 100, "x"))
    sales += sales[:9] + [sales[3]] * 20
    changes += changes[:30] + [(*changes[40][:5], 1.5, "y"), (None, 7, 1, "U", DAY + datetime.timedelta(days=100), 2.0, "x")]
    return sales, changes


def test_against_a_loop_and_sql(spark):
    """Client 7 is hot, the others are not."""
    sales, changes = made(2)
    got = rows_of(validtime.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), 150))
    assert got == sorted(map(repr, brute(sales, changes)))
    c = duckdb.connect()
    c.execute("CREATE TABLE sales (sale_id bigint, client_id bigint, sold_at timestamp, arrived_at timestamp, slot int)")
    c.execute("CREATE TABLE client_changes (change_id bigint, client_id bigint, seq bigint, op varchar, valid_at timestamp, balance double, note varchar)")
    c.executemany("INSERT INTO sales VALUES (?, ?, ?, ?, ?)", sales)
    c.executemany("INSERT INTO client_changes VALUES (?, ?, ?, ?, ?, ?, ?)", changes)
    rel = c.sql(validtime.SQL)
    at = [rel.columns.index(n) for n in COLUMNS]
    assert sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()) == got


def test_sql_and_loop_over_more_tables():
    """Without the stages: whether the loop, which they are held against, and the SQL read the contract alike."""
    for seed in range(3, 9):
        sales, changes = made(seed, 300, last=30 + 20 * seed)
        c = duckdb.connect()
        c.execute("CREATE TABLE sales (sale_id bigint, client_id bigint, sold_at timestamp, arrived_at timestamp, slot int)")
        c.execute("CREATE TABLE client_changes (change_id bigint, client_id bigint, seq bigint, op varchar, valid_at timestamp, balance double, note varchar)")
        c.executemany("INSERT INTO sales VALUES (?, ?, ?, ?, ?)", sales)
        c.executemany("INSERT INTO client_changes VALUES (?, ?, ?, ?, ?, ?, ?)", changes)
        assert sorted(map(repr, c.sql(validtime.SQL).fetchall())) == sorted(map(repr, brute(sales, changes)))


def test_empty_tables_and_an_empty_first_batch(spark, monkeypatch):
    monkeypatch.setattr(validtime, "BATCHES", 1)
    assert rows_of(validtime.enrich(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES))) == []


def test_settings_are_given_back(spark):
    before = {k: spark.conf.get(k, None) for k in validtime.SETTINGS}
    with validtime._settings(spark, validtime.SETTINGS):
        assert all(spark.conf.get(k) == v for k, v in validtime.SETTINGS.items())
    assert {k: spark.conf.get(k, None) for k in validtime.SETTINGS} == before


def test_a_start_opens_one_store_a_partition(spark, monkeypatch):
    """Each store that a start opens leaves memory behind, so gate and versions share one; held sales and versions are both kept there."""
    stores, clean = [], validtime.Enrichment.clean

    def looked_at(run):
        at = run.root.removeprefix("file:") + "/checkpoint/state"
        stores.extend(f"{d}/{p}" for d in os.listdir(at) if d.isdigit() for p in os.listdir(f"{at}/{d}") if p.isdigit())
        clean(run)

    monkeypatch.setattr(validtime.Enrichment, "clean", looked_at)
    monkeypatch.setattr(validtime, "BATCHES", 2)
    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    sales = [(1, 1, at(5), at(5), 1), (2, 1, at(80), at(80), 1), (3, 1, at(4), at(90), 1), (4, 1, at(20), at(20), 1)]
    changes = [(c, 1, 0, "U", at(day), float(c), "x") for c, day in ((1, 1), (2, 3), (3, 79), (4, 81), (5, 30))]
    got = validtime.enrich(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES))
    assert sorted((r["id"], r["batch"], r["change_id"]) for r in got.collect()) == [(1, 1, 2), (2, 2, 3), (3, 1, 2), (4, 2, 2)]
    assert sorted(stores) == [f"0/{p}" for p in range(4)]
