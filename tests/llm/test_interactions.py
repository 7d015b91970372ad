"""Filter interaction audit: the SQL over tables of edge cases, and every figure of random flags by removing one after another."""

import itertools
import random

import duckdb
import pytest

from datagauge.llm import interactions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(120))


def rows_of(df):
    return sorted((r["part"], r["filter_order"], r["step"], *(r[c] for c in interactions.COUNTS)) for r in df.collect())


def by_sql(docs, labels):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id bigint, text varchar, lang varchar)")
    c.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in docs])
    if labels:
        c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    rel = c.sql(interactions.SQL)
    at = [rel.columns.index(n) for n in ["part", "filter_order", "step", *interactions.COUNTS]]
    return sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_edge_cases(spark):
    texts = [LONG, LONG, None, "", "", "ÄÖÜ äöü", "THE END # of it", LONG.upper(), "a " * 200, "\t\x0b one\x0ctwo three \n", LONG + " $", "x" * 300_000, LONG]
    docs = [(i if i != 5 else None, t, [None, "", "en", "de"][i % 4], "s", 0) for i, t in enumerate(texts)]
    docs += [(0, LONG, "en", "s", 0), (0, LONG, "en", "s", 0), (None, LONG, "en", "s", 0), (None, LONG, "de", "s", 0), (-3, "", None, "s", 0)]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (4, 0, 0), (7, 1, 0), (99, 1, 1), (12, 1, 0), (12, 1, 0)]
    got = rows_of(interactions.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == by_sql(docs, labels)
    assert len(got) == 3 * 600 and any(r[0] == "" for r in got)


def test_no_labels_clashing_names_and_no_documents(spark):
    docs = [(i, f"{LONG} {i % 3}", "en", 1, 2, "x", 3) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, part int, n int, mark string, key int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows_of(interactions.audit(df, none))
    assert got == by_sql(docs, []) and got[0][3:5] == (9, 0)
    assert rows_of(interactions.audit(df.limit(0), none)) == []


@pytest.mark.parametrize("filters", ["AB", "ABCDE"])
def test_inversion_by_removal(spark, filters):
    """Any number of filters, from rows with given failures."""
    rng, k = random.Random(5), len(filters)
    rows = [(rng.choice("xy"), rng.randrange(1 << k), rng.randrange(1, 4), 1, 0) for _ in range(60)]
    df = spark.createDataFrame(rows, "part string, fails int, n long, good long, toxic long")
    got = {r[:3]: r[3:] for r in rows_of(interactions.invert(interactions.joint(df, k), filters))}
    orders = ["".join(o) for o in itertools.permutations(filters)]
    credit = {}
    for part in "xy":
        for order in orders:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                bit = 1 << filters.index(f)
                gone = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                fail = sum(r[2] for r in rows if r[0] == part and r[1] & bit)
                removed = sum(r[2] for r in gone)
                credit[part, f] = credit.get((part, f), 0) + removed
                alone = sum(r[2] for r in rows if r[0] == part and r[1] == bit)
                assert got[part, order, step][:6] == (sum(r[2] for r in left), removed, fail - removed, alone, len(gone), 0)
    assert all(got[p, o, s][6] == credit[p, o[s - 1]] for p, o, s in got)
