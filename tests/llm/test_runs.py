"""Periodic runs against every period at every place, with hash collisions, odd rows and the SQL of the query."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, times * q):
                out.setdefault((start, size), q)
            i += 1
    return sorted(((s, size, q) for (s, size), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 5)):
            root = [rng.randint(1, rng.choice([1, 2, 6])) for _ in range(rng.randint(1, 6))]
            words += (root * 40)[: rng.randint(1, 40)] + [rng.randint(1, 4) for _ in range(rng.randint(0, 4))]
        yield words


def test_runs_and_stretches():
    from stratalake.llm.periodic_runs import runs_of, text_runs

    for words in texts(1, 600):
        assert runs_of(words) == plain_runs(words)
        several = [words, words[::-1], [], [1] * (len(words) % 9)]
        ids, ends = np.array(sum(several, []), np.int64), np.cumsum([len(w) for w in several])
        assert text_runs(ids, ends) == [plain_runs(w) for w in several]


def test_collisions_are_verified(monkeypatch):
    from stratalake.llm import periodic_runs

    monkeypatch.setattr(periodic_runs, "PRIME", 5)
    for words in texts(2, 200):
        assert periodic_runs.runs_of(words) == plain_runs(words)


def test_long_runs():
    from stratalake.llm.periodic_runs import runs_of

    assert runs_of([1] * 200_000) == [(0, 200_000, 1)]
    assert runs_of([*range(1, 3001)] * 40) == [(0, 120_000, 3000)]


def test_strongest():
    from stratalake.llm.periodic_runs import strongest

    assert strongest([(9, 12, 3), (0, 8, 2), (0, 16, 4)]) == (0, 8, 2)
    assert strongest([(0, 13, 3), (20, 9, 2)]) == (20, 9, 2)
    assert strongest([]) is None


def test_odd_rows(spark):
    from stratalake.llm.periodic_runs import collapse_runs, run_digests

    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b\x0ba b\ra b a b a b end", "x"), (4, "a b a b a b a b a b end", "x"), (None, "é é é é é é", "x"), (5, "w " * 50_000, "x"), (6, "to be or not", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(docs).collect()), key=str)
    wanted = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 11, [(0, 10, 2)], "a b end"), (4, 11, [(0, 10, 2)], "a b end"), (None, 6, [(0, 6, 1)], "é"), (5, 50_000, [(0, 50_000, 1)], "w"), (6, 4, [], "to be or not")]
    assert got == sorted(wanted, key=str)
    digests = {r.doc_id: r for r in run_digests(docs.where("doc_id = 1 or doc_id is null")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digests[1]) == (1, 0, None, None, None, None, empty, empty)
    assert tuple(digests[None]) == (None, 1, 0, 6, 1, 6000, hashlib.sha256(b"0,6,1\n").hexdigest(), hashlib.sha256("é".encode()).hexdigest())
    assert run_digests(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_periodic_runs"])
def test_sql(spark, name):
    from stratalake.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = queries()[name](spark, SMALL)
    columns = ", ".join(df.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(df.collect()) == plain(con.execute(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall())
