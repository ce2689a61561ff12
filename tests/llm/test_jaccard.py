"""The n-gram Jaccard join on dense groups, shared ids and odd tables, against brute force."""

import re

import numpy as np
import pytest
from stratalake.llm import jaccard_join as J

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(s, t):
    return bool(s and t) and 100 * len(s & t) >= 80 * len(s | t)


def brute(texts):
    """(links by set, smallest reachable id by row), of rows (id, text)."""
    sets = [shingles(t) for _, t in texts]
    distinct = list(dict.fromkeys(s for s in sets if s))
    near = {s: [t for t in distinct if t != s and linked(s, t)] for s in distinct}
    root = {}
    for s in distinct:
        if s not in root:
            todo, root[s] = [s], s
            while todo:
                for t in near[todo.pop()]:
                    if t not in root:
                        root[t] = s
                        todo.append(t)
    least = {}
    for (i, _), s in zip(texts, sets):
        if s and i is not None:
            least[root[s]] = min(i, least.get(root[s], i))
    return {s: len(n) for s, n in near.items()}, [least[root[s]] if s and i is not None else i for (i, _), s in zip(texts, sets)], root


def near_copies(n, seed=4):
    """Copies of one text with so many words changed that similarities lie around the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for k in range(n):
        words = list(base)
        for i in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            words[i] = f"n{k}x{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("cuts", [{}, {"LIST": 40, "SKIP": 7, "SPOKES": 9, "BLOCK": 30}])
def test_dense_group(spark, monkeypatch, cuts):
    for name, value in cuts.items():
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(8)
    texts = [(i, t) for i, t in enumerate(near_copies(300))] + [(1000 + i, " ".join(f"q{x}" for x in rng.integers(0, 30, 40))) for i in range(40)]
    links, least, _ = brute(texts)
    assert 300 * 20 < sum(links.values()) < 300 * 290
    found = {r.doc_id: r for r in J.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for (i, text), component in zip(texts, least):
        assert (found[i].n_shingles, found[i].component_id, found[i].n_links) == (len(shingles(text)), component, links.get(shingles(text), 0))


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    import pyarrow as pa

    for na, nb, both in [(100, 120, 90), (130, 127, 1), (6000, 6500, 5900), (1, 1, 0), (500, 520, 450)]:
        a, b = np.unique(pool[:na]), np.unique(pool[na - both : na - both + nb])
        differ = len(np.setxor1d(a, b))
        one, two = J.Signatures(pa.array([J.signature(a)])), J.Signatures(pa.array([J.signature(b)]))
        zero = np.zeros(1, np.int64)
        left = J.slack(one, zero, np.array([len(a)]), two, zero, np.array([len(b)]))[0]
        allowed = len(a) + len(b) - 2 * J.required(len(a), len(b))
        assert allowed - left <= differ
        assert left >= 0 or differ > allowed


def test_long_texts_in_pieces():
    texts = [b"one two\tthree  four five six\n" * 40, b"x" * 90 + b" a b c d e f", b"", b" \n", b"a b c", "é ü ß ø å".encode() * 9]
    whole = J.shingle_sets(texts)
    for piece in (1, 7, 64):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, J.shingle_sets(texts, piece=piece)))


def test_keep_one_of_each(spark):
    group = near_copies(30, seed=1)
    other = "a wholly different text of several words that nothing else here is like"
    rows = [(1, group[0]), (7, group[0]), (7, other), (8, group[1]), (8, group[1]), (9, None), (9, ""), (None, other), (20, "few words"), (21, "few words"), (20, "few words")]
    rows += [(100 + i, t) for i, t in enumerate(group)]
    table = spark.createDataFrame([(i, t, f"m{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component_id string, node int")
    assert J.keep_one_of_each(table.where("false")).count() == 0
    out = J.keep_one_of_each(table)
    assert out.columns == table.columns and out.schema == table.schema
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    _, _, root = brute(rows)
    kept, expected = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingles(t)
        if not s or i is None:
            expected.append((i is None, i or 0, t or ""))
        elif root[s] not in kept:
            kept.add(root[s])
            expected.append((False, i, t))
    assert [x[:2] for x in found] == sorted(x[:2] for x in expected)
    assert (False, 7, other) in found and (False, 1, group[0]) in found and (False, 20, "few words") in found
