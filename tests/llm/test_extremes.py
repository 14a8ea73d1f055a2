"""Words that trick weak hashes, very long texts, and vectors near the ends of the number range."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadvane.llm import ann, minhash, substring
from leadvane.llm import words as W
from leadvane.llm.common import prepare


def morse(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s[:n]


def hashes(texts):
    out = []
    for _, _, data, off in W.chunks(pa.array(texts)):
        start, end, first = W.split(data, off)
        h = W.word_hashes(data, start, end)
        out += [h[i:j].tolist() for i, j in zip(first[:-1], first[1:])]
    return out


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    vocab = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(3000)} | {morse(1024, "a", "b"), morse(1024, "b", "a"), "a" * 8, "a" * 9, "a" * 16}
    vocab = sorted(vocab)
    got = {}
    for texts in ([" ".join(vocab)], ["x " + " ".join(vocab[::-1])]):
        words = texts[0].split(" ")
        for word, h in zip(words, hashes(texts)[0]):
            assert got.setdefault(word, h) == h
    assert len(set(got.values())) == len(got)


def test_complementary_words_are_not_repeats(spark):
    x, y = morse(1024, "a", "b"), morse(1024, "b", "a")
    rows = [(1, " ".join([x] * 13)), (2, " ".join([y] * 13)), (3, x), (4, y)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r.component_id == r.doc_id for r in minhash.near_groups(df).collect())


def test_selected_places_have_no_size_limit():
    rng = np.random.default_rng(3)
    h = (rng.integers(0, 50, 2000).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 99, 2000).astype(np.uint64)
    got = W.selected(h, 7)
    assert got.tolist() == [i + int(np.argmin(h[i:i + 7] >> np.uint64(24))) for i in range(1994)]
    many = np.full((1 << 24) + 5, 9 << 24, np.uint64)
    many[1 << 24] = 0
    got = W.selected(many, 3)
    assert got[(1 << 24) - 2:].tolist() == [1 << 24] * 3 + [(1 << 24) + 1, (1 << 24) + 2] and got[0] == 0


@pytest.mark.parametrize("k", [5])
def test_vectors_of_any_size(spark, k):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)) * np.repeat([1.0, 1e39, 1e200, 1e-200, 1e-30, 1.0], 10)[:, None]
    v[7] = 1e39
    df = prepare(spark).createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.lit(True), ann.CodeSpec(k=k, codes_in_block=16, queries_in_block=7)).collect()
    for i in range(60):
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.zeros(60)
            for d in range(8):
                score += v[i, d] * v[:, d]
        others = [j for j in range(60) if j != i and not np.isnan(score[j])]
        want = [(j, score[j]) for j in sorted(others, key=lambda j: (-score[j], j))[:k]]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want
