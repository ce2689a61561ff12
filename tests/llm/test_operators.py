"""The training-data operators against brute force, libraries and round trips, with nulls, empties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "the same words come here twice in a row " * 9), (6, "the same words come here twice in a row " * 9), (7, "é▁ ﬁ \x00 <s> 𐍈 " * 30), (7, "again the id seven"), (None, "no id at all here"), (9, "x" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", "m") for i, t in ODD], "doc_id long, text string, lang string, source string, media string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_packing(spark, documents, odd, empty):
    from stratalake.llm.packing import pack_documents
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
    assert pack_documents(empty, *args).count() == 0
    pieces = pack_documents(odd, *args).toPandas()
    assert pieces["length"].sum() == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    texts = {r.doc_id: r.text for r in documents.collect()}
    pieces = pack_documents(documents, *args).toPandas()
    for doc_id, rows in pieces.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows["offset"]) == [0, *rows["length"].cumsum()[:-1]]
        sizes.append(rows["length"].sum())
    assert max(sizes) <= 1024
    assert sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes) < 0.02 * sum(sizes)


def test_packing_ids():
    import random

    from stratalake.llm.packing import Encoder
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
    encoder, short = Encoder(*args), Encoder(*args, run=5)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "a", "Bc", " ", "  ", "\n", "\t", "\u3000", "é", "12", "'s", "<|", "endoftext", "|>", ".", "\x1c", "\xa0", " " * 6, "\n" * 7, "𐍈", "word"]
    for text in ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids and short.encode(text).tolist() == ids, text
    for text in ("x" + " " * 2_000_000 + "y", "\n" * 1_000_000):
        assert encoder.plain.decode(encoder.encode(text).tolist()) == text


def test_best_cuts_are_cheapest():
    from stratalake.llm.packing import best_cuts

    rng = np.random.default_rng(3)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        price = rng.integers(0, 3, 13)
        best = {0: 0}
        powers = {1, 2, 4, 8}
        for i in range(1, 13):
            best[i] = min(best[j] + (0 if at[i] - at[j] in (powers if i == 12 else ()) else 16 - (at[i] - at[j])) + price[i] for j in range(i) if at[i] - at[j] <= 16)
        cuts = best_cuts(at, price, 16)
        cost, last = 0, 0
        for c in cuts:
            n = c - last
            cost += (0 if c == at[-1] and n & (n - 1) == 0 else 16 - n) + price[np.searchsorted(at, c)]
            last = c
        assert cost == best[12]


def test_jaccard_join(spark, documents, odd, empty):
    from stratalake.llm.jaccard_join import similar_documents

    assert similar_documents(empty).count() == 0
    found = {(r.doc_id, r.n_shingles): r.component_id for r in similar_documents(odd).collect()}
    assert found[(1, 0)] == 1 and found[(2, 0)] == 2 and found[(4, 1)] == 4 and found[(6, 9)] == 5
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {}
    for r in documents.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(up))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[r.doc_id] = r.doc_id

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    for r in similar_documents(documents).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), top(r.doc_id))


@pytest.mark.parametrize("block", [1024, 7])
def test_jaccard_counts_all_links(spark, documents, monkeypatch, block):
    from stratalake.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    near = [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in range(3, 83, 2)]
    chain = [" ".join(f"c{i}" for i in range(k * 10, k * 10 + 110)) for k in range(8)]
    texts = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + i, t) for i, t in enumerate(near + chain + near[:2])]
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kinds = {}
    for doc_id, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(up))
        kinds[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = {}
    for s in set(kinds.values()):
        links[s] = sum(t != s and 100 * len(s & t) >= 80 * len(s | t) for t in set(kinds.values()) if s and t)
    assert links[kinds[10_000]] == len(near) - 1 and len({links[kinds[10_040 + i]] for i in range(8)}) > 1
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard_join.similar_documents(table).collect()} == {i: links[s] for i, s in kinds.items()}


def test_media_stream(odd, empty):
    from stratalake.llm.media_stream import StreamError, add_stream, demux, mux, padded, read_streams

    assert read_streams(add_stream(empty)).count() == 0
    rows = read_streams(add_stream(odd)).collect()
    assert sorted(r.payload_sha256 for r in rows) == sorted(hashlib.sha256(padded((t or "").encode())).hexdigest() for _, t in ODD)
    for n in (0, 1, 64, 176, 184, 32767, 32769, 100_000):
        payload = padded(b"q" * n)
        stream = demux(mux(payload))
        assert stream["payload"] == payload and stream["gaps"] == 0 and stream["points"] == stream["units"]
    broken = mux(padded(b"z" * 2000))
    assert demux(broken[: 188 * 4] + broken[188 * 5 :])["gaps"] == 1
    with pytest.raises(StreamError):
        demux(b"x" * 188)


def test_piece_encoding(documents, odd, empty):
    import sentencepiece
    from stratalake.llm.piece_encoding import encode_documents, encoding_digests, load_model

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), load_model(path)
    assert encoding_digests(empty, path).count() == 0
    for text in [r.text for r in documents.collect()] + [t or "" for _, t in ODD]:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    assert encode_documents(odd, path).count() == len(ODD)


def test_nearest(spark):
    from stratalake.llm.tree_forest import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:200] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8), (550, [None] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert nearest(table.where("false")).count() == 0
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(table).collect()}
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 400, 50):
        score = y @ y[q] / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q])
        order = [i for i in np.lexsort((np.arange(400), -np.round(score, 12))) if i != q][:5]
        for rank, i in enumerate(order, 1):
            hits += found[(q, rank)][0] == i
    assert hits >= 0.9 * 40 and not any(q >= 400 for q, _ in found)


def test_quality(spark, documents, odd, empty):
    from stratalake.llm.quality_trees import keep_good, score_documents

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = score_documents(full, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.93
    assert score_documents(odd, labels.where("false")).count() == len(ODD)
    assert score_documents(empty, labels).count() == 0
    assert keep_good(full, labels).columns == full.columns


def test_top_word_counts_all_words():
    from stratalake.llm.quality_trees import FEATURES, statistics

    at = FEATURES.index("top_word")
    assert statistics(b"one two three " + b"junk " * 7)[at] == 0.7 and statistics(b" ")[at] == 0 and statistics(b"")[at] == 0
    assert statistics(b"a b a c")[FEATURES.index("distinct_words")] == 0.75


def test_lattice(odd, empty, documents):
    from stratalake.llm.lattice_model import held_out, load_vocabulary, score_texts, word_scores, words_of

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = load_vocabulary(path)
    probability = dict(zip(vocabulary.pieces, np.exp(vocabulary.start)))

    def total(word):
        sums = [1.0] + [0.0] * len(word)
        for i in range(1, len(word) + 1):
            sums[i] = sum(sums[j] * probability.get(word[j:i], 0) for j in range(i))
        return np.log(sums[-1])

    words = ["the", "thtion", "a", "éeau", "blehehewh"]
    assert np.allclose(word_scores(vocabulary, vocabulary.start[None], words)[:, 0], [total("▁" + w) for w in words])
    assert score_texts(empty, path).count() == 0
    assert score_texts(odd, path).count() == len(ODD)
    rows = documents.collect()
    counts: dict = {}
    for r in rows:
        if not held_out(r.doc_id):
            for w in [*words_of(r.text.encode()), b""]:
                counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    found = {r.doc_id: r for r in score_texts(documents, path).collect()}
    for r in rows:
        mine = [*words_of(r.text.encode()), b""]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in mine)
        got = found[r.doc_id]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(mine), sum(w in counts for w in mine), n) and abs(got.base_score - base) < 1e-6 and got.score < 0


def test_urls(spark):
    from stratalake.llm.url_models import judge_urls

    urls = ["http://a.NET/x", "https://m.example.net/en/1", "http://x.example.com/de/9?q", "http://org/fr/2", "http://net", "http://notnet/", None, "no scheme", "http://casino-win.example.com/en/1", "http://therea.example.com/en/2", "http://poker.example.org/en/3"] + [f"http://ththan{i % 7}.example.org/en/{i}" for i in range(40)]
    rows = {r.page_id: r for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [rows[i]["rule"] for i in range(8)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [rows[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"] and rows[0].host == "a.net" and rows[6].host == "" and rows[6].verdict == "allow"
    assert rows[8].verdict == "block" and rows[10].verdict == "block" and rows[20].verdict == "allow"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("large", [100_000, 2])
def test_suffix_dedup(documents, odd, empty, large):
    from stratalake.llm.suffix_dedup import remove_repeats, without_repeats

    assert remove_repeats(empty).count() == 0
    assert without_repeats(odd).columns == odd.columns and without_repeats(odd).count() == len(ODD)
    seen, expected = set(), {}
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        t = r.text.encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(t[s : s + 100])
        expected[r.doc_id] = (len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))
    kept = F.when(F.col("n_removed") == 0, F.lit(None)).otherwise(F.col("kept"))
    for r in remove_repeats(documents, large=large).withColumn("kept", kept).collect():
        n, removed, left = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (n, removed) and (r.kept is None or bytes(r.kept) == left)


def test_page_text(spark):
    from stratalake.llm.page_text import blocks_of, emissions, extract_pages, feature_rows, labelled_pages, trained_field, viterbi

    weights, moves = trained_field()
    wrong = total = 0
    for page, labels in labelled_pages(100, seed=5):
        found = viterbi(emissions(weights, feature_rows(blocks_of(page))), moves)
        wrong, total = wrong + sum(a != b for a, b in zip(found, labels)), total + len(labels)
    assert wrong < 0.01 * total
    page = "<nav><ul><li><a href=/a>menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Four</article><footer>&copy; us</footer>"
    rows = {r.page_id: r for r in extract_pages(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")).collect()}
    assert rows[1].text == "A & B\nOne two three.\nFour" and rows[2].text == "" and rows[3].n_chars == 0
