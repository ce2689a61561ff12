"""Hand-written pages, and long texts in pieces."""

import time

import numpy as np
import pytest

PAGES = {
    "unclosed video": ("<article><h1>Head line here</h1><video src=x><p>First part of the article goes on here.</p><p>Second part of it, with more words.</p></article>", "Head line here\nFirst part of the article goes on here.\nSecond part of it, with more words."),
    "quote": ('<article><h1>Head line here</h1><p class="x>One sentence stands here now.</p><p id="y">Another sentence is to follow.</p></article>', "Head line here\nOne sentence stands here now.\nAnother sentence is to follow."),
    "form": ("<article><h1>Head line here</h1><p>One sentence stands here now.</p><form><p>Write to us about this text, please.</p><input><button>Send</button></form><p>Another sentence is to follow.</p></article>", "Head line here\nOne sentence stands here now.\nAnother sentence is to follow."),
    "formula": ("<article><h1>Head line here</h1><p>The value <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is large.</p></article>", "Head line here\nThe value x+1 is large."),
    "script": ("<article><h1>Head line here</h1><script>var a = '</p>';</script><p>One sentence &amp; another, stands here.</p></article><footer>&copy; all of us</footer><script>open", "Head line here\nOne sentence & another, stands here."),
    "greater": ('<article><p title="a > b" class="c">One sentence stands here now.</p><p>Another sentence is to follow.</p></article>', "One sentence stands here now.\nAnother sentence is to follow."),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_page(name):
    from stratalake.llm.page_text import main_text, trained_field

    page, text = PAGES[name]
    assert main_text(page, trained_field()) == text


def test_deep_page_takes_linear_time():
    from stratalake.llm.page_text import blocks_of

    began = time.time()
    assert len(blocks_of("<div>x" * 20_000)) == 20_000
    assert time.time() - began < 5


def test_field_is_the_best_labelling():
    """Viterbi against all labellings of short chains."""
    import itertools

    from stratalake.llm.page_text import viterbi

    rng = np.random.default_rng(3)
    for n in range(1, 8):
        scores, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def total(labels):
            return sum(scores[i, x] for i, x in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

        assert np.isclose(total(viterbi(scores, moves)), max(map(total, itertools.product((0, 1), repeat=n))))


def test_anchors_in_pieces():
    from stratalake.llm.suffix_dedup import anchors

    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, 5000, dtype=np.uint8)), b"ab" * 900, b"", b"short", bytes(rng.integers(0, 255, 1200, dtype=np.uint8))]
    whole = [np.array(c) for c in anchors(texts)]
    for piece in (150, 333, 2000):
        for a, b in zip(whole, anchors(texts, piece=piece)):
            assert len(a) == len(b) and (a == b).all()
