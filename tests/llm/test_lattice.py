"""Lattice sums against all segmentations, and the scores against plain counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quirelight.llm.lattice_lm import SPACE, Lattice, lattice_scores, tokens
from quirelight.llm.spm import model_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return Lattice(model_bytes(MODEL))


def segmentations(lattice, text):
    """(log, pieces) of every way to write the text."""
    if not text:
        yield 0.0, ()
        return
    for k in range(1, len(text) + 1):
        i = lattice.automaton.get(text[:k], None)
        if i is not None:
            for log, rest in segmentations(lattice, text[k:]):
                yield lattice.logs[i] + log, (i, *rest)
        elif k == 1:
            ids = lattice.byte_ids[list(text[0].encode())]
            for log, rest in segmentations(lattice, text[1:]):
                yield lattice.logs[ids].sum() + log, (*ids, *rest)


def test_tokens_are_cut_at_six_signs_only():
    import re

    text = "Ab\tC\x0bd\x0cE\rF\nÄÖ\x85g\xa0h\x1ci\u2028j İK  \x00L"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in tokens(text)] == re.findall("[^\x20\x09-\x0d]+", low)
    assert tokens("") == tokens(" \n") == []


def test_sums_and_expected_uses_are_those_of_all_segmentations(lattice):
    words = ["the", "aßt", "🙂x", "running", "x" * 9, "é.", "a☃☃b", "z" * 130]
    got = lattice.log_probabilities(words)
    uses, want = np.zeros(len(lattice.logs)), np.zeros(len(lattice.logs))
    lattice.expected(words[:-1], np.arange(1, 8), uses)
    for k, word in enumerate(words[:-1]):
        ways = list(segmentations(lattice, SPACE + word))
        total = sum(math.exp(log) for log, _ in ways)
        assert got[k] == pytest.approx(math.log(total))
        for log, pieces in ways:
            for i in pieces:
                want[i] += (k + 1) * math.exp(log) / total
    assert uses == pytest.approx(want)
    assert math.isfinite(got[-1])


def test_scores(spark, lattice):
    rng = random.Random(2)
    vocabulary = ["Alpha", "beta", "gamma", "δέλτα", "x" * 90, "the", "of"] + [f"word{i}" for i in range(40)]
    rows = [(i, " \n".join(rng.choices(vocabulary, k=rng.randint(0, 30))), "k") for i in range(80)]
    rows += [(None, "the of", "k"), (200, None, "k"), (3, "repeated the the", "k"), (3, "repeated the the", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, text, _ in rows:
        if not held(i):
            counts.update([*tokens(text or ""), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, _ in rows:
        own = [*tokens(text or ""), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    for head in (5, 1000):
        got = lattice_scores(df, MODEL, head=head).collect()
        assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
        assert all(r.score < 0 for r in got)
        if head == 5:
            first = sorted((str(r.id), round(r.score, 6)) for r in got)
    assert first == sorted((str(r.id), round(r.score, 6)) for r in got)
    assert lattice_scores(df.limit(0), MODEL).count() == 0


def test_frequent_words_are_bounded(spark):
    from quirelight.llm.lattice_lm import _frequent

    words = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(200)], "word string, c bigint")
    for head in (0, 1, 7, 50, 1000):
        found = _frequent(words, head)
        assert len(found) <= head
        least = min((r.c for r in found), default=10**9)
        assert {r.word for r in found} == {f"w{i}" for i in range(200) if 1000 // (i + 1) >= least}
    assert len(_frequent(words, 1000)) == 200
    assert _frequent(words.limit(0), 10) == []
