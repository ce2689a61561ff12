"""Scores against row-wise brute force: word lattices, trees, pruned searches; the join against its SQL; the pipeline."""

import os

import duckdb
import numpy as np
import public_tokenizers
from stratalake.llm import queries

from tests.llm.test_jaccard import brute, near_copies

SMALL = "/root/testdata/sf0.001"


def test_join_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, n_links FROM ({queries.oracle_sql()['op2_ngram_jaccard_join']})").fetchall())
    assert sorted(tuple(r) for r in queries.op2_ngram_jaccard_join(spark, SMALL).collect()) == expected


def test_document_scores(spark):
    """The mixture of languages, word by word from counts and the pieces' sums over segmentations."""
    from stratalake.llm import lattice_model as L

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(9)
    words = {"en": "the of and tion with" .split(), "fr": "le de et que éau".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 12)) + (" Newword" if i % 5 == 0 else ""), lang) for i, lang in enumerate(["en", "fr"] * 15)] + [(99, "the zzq le", "en"), (100, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in L.score_texts(docs, path).collect()}
    classes = ["en", "fr"]
    counts = [{}, {}]
    for i, text, lang in rows:
        if not L.held_out(i):
            for w in [*L.words_of((text or "").encode()), b""]:
                own = counts[classes.index(lang)]
                own[w] = own.get(w, 0) + 1
    total = {w: sum(c.get(w, 0) for c in counts) for w in {*counts[0], *counts[1]}}
    vocab = spark.createDataFrame([(w.decode(), *(c.get(w, 0) for c in counts)) for w in total if w], "word string, c0 long, c1 long")
    fitted = L.fit_scores(vocab, path, ["c0", "c1"])
    vocabulary = L.load_vocabulary(path)

    def piece(word, k):
        if not word:
            return fitted[k, -1]
        arcs = vocabulary.arcs([L.MARK + word.decode()])[0]
        sums = [0.0]
        for i in range(len(arcs)):
            sums.append(np.logaddexp.reduce([sums[i - j] + fitted[k, arcs[i, j]] for j in range(min(i + 1, arcs.shape[1])) if arcs[i, j] >= 0]))
        return sums[-1]

    def value(word, k):
        n, nk = sum(total.values()), sum(counts[k].values())
        overall = max(total.get(word, 0) - L.DISCOUNT, 0) / n + L.DISCOUNT * len(total) / n * np.exp(piece(word, k))
        return np.log(max(counts[k].get(word, 0) - L.DISCOUNT, 0) / nk + L.DISCOUNT * len(counts[k]) / nk * overall)

    prior = np.log([counts[k][b""] + 0.5 for k in (0, 1)]) - np.log(total[b""] + 1)
    for i, text, _ in rows:
        tokens = [*L.words_of((text or "").encode()), b""]
        score = np.logaddexp.reduce([prior[k] + sum(value(w, k) for w in tokens) for k in (0, 1)]) / np.log(10)
        assert np.isclose(found[i].score, score, rtol=1e-5), (i, text)
        chance = np.exp(prior - np.logaddexp.reduce(prior))
        assert np.isclose(found[i].lattice_score, sum(np.log(sum(chance[k] * np.exp(piece(w, k)) for k in (0, 1))) for w in tokens) / np.log(10), rtol=1e-5)


def test_long_words_are_summed_in_logarithms():
    from stratalake.llm import lattice_model as L

    vocabulary = L.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["𐍈" * 40, "x" * 2000, "the"]
    got = L.word_scores(vocabulary, vocabulary.start[None], words)[:, 0]
    logs = [vocabulary.lower(vocabulary.start, vocabulary.arcs([L.MARK + w]))[1][0, -1] for w in words]
    assert np.allclose(got, logs) and got[1] < -575
    uses = L.expected_pieces(vocabulary, vocabulary.start, words)
    assert np.isfinite(uses).all() and uses.sum() > 40


def test_trees_row_by_row():
    from stratalake.llm.quality_trees import fit_trees

    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    trees = fit_trees(x, y, rounds=12, depth=3)

    def walk(row):
        total = trees.base
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return total

    margins = np.array([walk(r) for r in x])
    assert np.allclose(trees.scores(x), 1 / (1 + np.exp(-margins)))
    assert ((margins > 0) == y).mean() > 0.9


def test_pruned_search_recall(spark):
    """Clustered vectors, of which a query's search opens a small part."""
    from stratalake.llm.tree_forest import nearest

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(table, least=300, share=0.1, leaf=32).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        score = y @ y[q]
        score[q] = -2
        hits += len(found[q] & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * 5 * 80


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    good = " ".join(f"word{i}" for i in range(90))
    odd = [(10_001, None), (10_002, ""), (10_003, good), (10_003, good), (10_004, good + " more"), (10_005, "tail " + good)] + [(10_100 + i, t) for i, t in enumerate(near_copies(6))]
    extra = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.schema)
    both = docs.unionByName(extra)
    os.makedirs(tmp_path / "sf")
    both.write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(str(tmp_path / "sf/labels.parquet"))
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "packing"]
    kept = stages["near_duplicates"](spark, both, SMALL)
    assert kept.columns == both.columns
    rows = [(r.doc_id, r.text) for r in both.collect()]
    _, _, root = brute(rows)
    from tests.llm.test_jaccard import shingles

    expected, seen = [], set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        s = shingles(t)
        if not s:
            expected.append(i)
        elif root[s] not in seen:
            seen.add(root[s])
            expected.append(i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    out = P.run(spark, str(tmp_path / "sf"))
    assert out.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 1024
    assert out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0
    for name, stage in P.STAGES:
        assert stage(spark, both.where("false"), str(tmp_path / "sf")).count() == 0, name
    wide = both.withColumns({"node": both.doc_id, "label": both.lang, "cut_id": both.doc_id})
    assert stages["repeated_passages"](spark, wide, SMALL).columns == wide.columns and stages["near_duplicates"](spark, wide, SMALL).columns == wide.columns
