"""Collocations against a count of every phrase, with many shards, blocks and ranges, odd words, and the SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def plain(rows, least, top):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            sizes[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {x: n for x, n in counts.items() if n >= least and len(x) > 2}
    out = []
    for (lang, *words), a in found.items():
        longer = (n for (other, *w), n in found.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))))
        if any(100 * n >= 80 * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, *words[:k]], counts[lang, *words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked = []
    for lang in sizes:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(ranked)


def table_of(seed):
    rng = random.Random(seed)
    words = ["a", "A", "a\x01", "\x00", "\x08b", "b", "é", "ab", "\x1f", "the", "of"]
    rows = [("en", None), ("en", ""), (None, "x y x y x y x y"), ("d\x00e", "of the of the"), ("en", " . , ;"), ("en", "the same line here. " * 30), (None, "x y"), ("fr", "İ İ z")]
    return rows + [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_phrase(spark, seed):
    from stratalake.llm.collocations import collocations

    rows = table_of(seed)
    docs = spark.createDataFrame([(t, la, 1, 2) for la, t in rows], "text string, lang string, n long, phrase long").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, 4, 40, sample=7, shard_paths=90, block_paths=5).collect())
    assert got == plain(rows, 4, 40)
    assert len(got) > 40


def test_ranges_of_a_hot_word(spark):
    from stratalake.llm.collocations import collocations

    rows = [("en", f"hot pair {k % 7} {k % 5} hot pair") for k in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(tuple(r) for r in collocations(docs, 10, 100, sample=3, shard_paths=100, block_paths=4).collect()) == plain(rows, 10, 100)
    assert collocations(docs.where("false")).count() == 0


def test_walk_over_bounds():
    from stratalake.llm.collocations import walk

    paths = [(b"6\0a", 2), (b"6\0a\0b", 3), (b"6\0a\0b\0c", 1), (b"6\0b", 9)]
    assert [n for n in walk(iter(paths), None, None, 4) if n[0] == b"6\0a\0b"] == [[b"6\0a\0b", 2, 4, 6, None, None, False]]
    some = {n[0]: n[1:] for n in walk(iter(paths), b"6\0a\0a", b"6\0b\0z", 4)}
    assert some[b"6\0a"] == [1, 6, None, None, None, True] and some[b"6\0b"][-1] and some[b"6\0a\0b"] == [2, 4, None, None, None, False]


def test_blocks():
    import numpy as np

    from stratalake.llm.collocations import merged_paths, pack, path_key, unpack

    words = [b"\x00", b"a", b"b"]
    block = pack(words, np.array([[1, 0, 0, 0], [1, 3, 0, 0], [3, 2, 1, 1]]), np.array([5, 1, 2]))
    keys = [path_key("en", w) for w in ([b"\x00"], [b"\x00", b"b"], [b"b", b"a", b"\x00", b"\x00"])]
    assert unpack(block, "en") == (keys, [5, 1, 2])
    assert list(merged_paths(iter([(keys[0], "en", block), (keys[0], "en", block)]))) == [(keys[0], 10), (keys[1], 2), (keys[2], 4)]


def test_sql(spark):
    from stratalake.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    df = queries()["op13_collocations"](spark, SMALL)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.collect()) == text(con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()['op13_collocations']})").fetchall())
