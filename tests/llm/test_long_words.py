"""op6's code for words of more than LONG characters, against the library: letters, signs, periods, and texts of one letter."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import prefixes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair(spark):
    def count(texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
        return [r["n_tokens"] for r in sorted(prefixes.count_tokens(rows, PATH, carry=["i"]).collect(), key=lambda r: r["i"])]

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return count, lambda texts: [len(library.encode(t)) for t in texts]


def made(seed):
    draw = random.Random(seed)
    n = prefixes.LONG + draw.randint(1, 3000)
    kind = draw.randrange(6)
    if kind == 0:  # of one unit, again and again
        unit = "".join(draw.choice("abcthe1é日") for _ in range(draw.randint(1, 9)))
        return (unit * n)[:n]
    alphabet = ["abcdefghijklmnopqrstuvwxyz", "aab", "日本語中文字一二三", "éàßñ½́😀a", "0123456789abcdef"][kind - 1]
    word = "".join(draw.choice(alphabet) for _ in range(n))
    at = draw.randrange(n)
    return word[:at] + word[at] * draw.randint(0, 700) + word[at:]  # with a run of one character


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=4, max_size=4))
def test_long_words_equal_the_library(pair, seeds):
    count, library = pair
    texts = [w for s in seeds for w in (made(s), f"x {made(s + 1)} y")]
    assert count(texts) == library(texts)


def test_borders_of_stretches(pair):
    count, library = pair
    texts = [c * n for c in ("a", "日") for n in (prefixes.LONG - 1, prefixes.LONG, prefixes.LONG + 1, prefixes.LONG + prefixes.STRETCH, 20_000)]
    assert count(texts) == library(texts)


def test_one_letter_takes_bounded_time(pair):
    count, _ = pair
    count(["warm"])
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        count(["e" * n])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 2
