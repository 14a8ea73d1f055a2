"""Near duplicates and the pipeline next to brute force on whole small tables."""
import re
from itertools import combinations

import numpy as np
import pytest

from leadvane.llm import minhash
from leadvane.llm.common import prepare

SF = "/root/testdata/sf0.001"


def shingles(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(sets, 2):
        if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_groups(df).collect()
    want = plain_groups([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {(i, len(shingles(t))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_small_table(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark):
    prepare(spark)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(base[:57])), (4, " ".join(base[3:] + ["x", "y", "z"])), (5, None), (6, ""), (7, " \t\n"),
            (8, "one two"), (9, "ONE  two"), (10, "one two three"), (11, None), (None, " ".join(base)), (2, " ".join(base)), (12, "one two"), (12, "other words here in a row of eight"),
            (13, "other words here in a row of eight"), (14, " ".join(base * 300))]
    check(spark, rows)
    assert minhash.near_groups(spark.createDataFrame([], "doc_id long, text string, comp long")).collect() == []


def test_chain_in_one_block_and_over_blocks(spark):
    """A chain of neighbours, each near the next only, with blocks of two members, is one group."""
    prepare(spark)
    words = [f"c{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 6:i * 6 + 100])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, minhash.NearSpec(block=2, set_block=2)).collect()}
    assert got == plain_groups(rows) and len(set(got.values())) == 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    a, b = np.sort(universe[:2000]), np.sort(universe[1000:])
    sig = minhash.super_minhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 128)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.15
    few = minhash.super_minhash(np.concatenate([a[:3], a[:3]]), np.array([0, 3, 6]), 128)
    assert (few[0] == few[1]).all() and (few[0] < np.uint64(128 << 32)).all()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(50)], [(5, i) for i in range(6, 40)] + [(3, 39), (100, 101)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
