"""Runs of blanks, ids with several texts, pages inside a form, labels and languages that must not count."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F


def test_runs_of_blanks_equal_the_library():
    import sentencepiece
    from stratalake.llm.piece_encoding import load_model

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)

    def same(text):
        ids = library.encode(text)
        assert ours.encode(text) == ids and ours.decode(ids) == library.decode(ids), text[:80]

    for n in [*range(1, 140), *range(140, 2000, 61)]:
        for text in (" " * n, "def f():\n" + " " * n + "return 1", "a" + " " * n, " " * n + "é☃", "| a" + " " * n + "| b |"):
            same(text)
    rng = random.Random(5)
    parts = ["a", "the", " ", "    ", "\t", "\n", "=", "--", "----", "....", "#", "*", "_", "▁", "0", "00", "é", "☃", "def ", " " * 9, "}", "aaaa", "ll"]
    for _ in range(3000):
        same("".join(rng.choice(parts) * rng.choice([1, 1, 1, 2, 3, 7, 20]) for _ in range(rng.randint(1, 12))))
    same("a" + " " * 300_000 + "b")


def removed_bytes(rows, length=100):
    """Of rows (doc_id, text) in order: bytes that repeated strings cover, row by row."""
    seen, out = set(), []
    for _, text in rows:
        raw, gone = text.encode(), set()
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out.append(len(gone))
    return out


def test_texts_that_share_an_id(spark):
    from stratalake.llm.suffix_dedup import remove_repeats

    rng = random.Random(4)
    x, y, z = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (400, 300, 150))
    docs = spark.createDataFrame([(1, x), (2, y + x), (2, x + y), (3, z), (3, z + z), (3, z), (4, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.digest, r.n_removed) for r in remove_repeats(docs).collect()}
    rows = sorted({(r.doc_id, r.text, r.digest) for r in docs.withColumn("digest", F.sha2("text", 256)).collect()}, key=lambda r: (r[0], r[2]))
    assert got == {(i, digest, n) for (i, _, digest), n in zip(rows, removed_bytes([r[:2] for r in rows]))}
    assert remove_repeats(docs).count() == 7
    assert {n for i, _, n in got if i == 2} == {400, 700}


PAGE = "<nav><ul><li><a href='/a'>Home page</a></li></ul></nav><article><h1>Head line here</h1><p>One sentence stands here now.</p><p>Another sentence is to follow.</p></article><footer>&copy; all of us</footer>"
TEXT = "Head line here\nOne sentence stands here now.\nAnother sentence is to follow."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><form method=post id=form1><input type=hidden>{PAGE}</form></body>", TEXT),
        (f"<body><form action=/s><p>Type a word to search for</p><button>Go</button></form><form>{PAGE}</form></body>", TEXT),
        ("<body><form><h1>Head line here</h1><p>One sentence stands here now.</p><p>Another sentence is to follow.</p></form></body>", TEXT),
        ("<body><form><p>Your name, please</p><label>Name</label><button>Send</button></form></body>", ""),
    ],
)
def test_pages_inside_a_form(page, text):
    from stratalake.llm.page_text import main_text, trained_field

    got = main_text(page, trained_field())
    assert got == text or not text and "Name" not in got and "Send" not in got


def test_labels_are_bounded_after_the_join(spark, monkeypatch):
    from stratalake.llm import quality_trees

    seen = []
    monkeypatch.setattr(quality_trees, "fit_trees", lambda x, y: seen.append((len(x), len(y))))
    docs = spark.range(3000).selectExpr("CASE WHEN id < 2900 THEN 1L ELSE id END AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").union(spark.createDataFrame([(1, 1), (1, None)], "doc_id long, quality int"))
    quality_trees.fit_on_labels(docs, labels, sample=5)
    quality_trees.fit_on_labels(docs, labels, sample=4000)
    assert seen == [(5, 5), (4000, 4000)] or seen[0] == (5, 5) and 80 <= seen[1][0] <= 4000


def test_held_out_languages_do_not_count(spark):
    from stratalake.llm.lattice_model import held_out, score_texts

    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(5)), "ab"[i % 2] if not held_out(i) else None) for i in range(60)]
    path = public_tokenizers.path("piece_bpe_32k.model")

    def scores(lang):
        docs = spark.createDataFrame([(i, t, lang if held_out(i) else x) for i, t, x in rows], "doc_id long, text string, lang string")
        return {r.doc_id: round(r.score, 9) for r in score_texts(docs, path, languages=1).collect()}

    assert scores("c") == scores("b")
