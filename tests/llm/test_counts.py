"""Line frequency, spelling variants and collocations next to plain Python on odd small tables."""
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from leadvane.llm import collocations, line_frequency, variants
from leadvane.llm.common import prepare

WORD = re.compile("[^\x20\x09-\x0D]+")
CLASH = "kept string, part int, n_lines int, word string, n int, f int, phrase string"
CLASHING = ("x", 1, 2, "y", 3, 4, "z")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def frame(spark, rows, columns):
    return prepare(spark).createDataFrame([(*r, *CLASHING) for r in rows], f"{columns}, {CLASH}").repartition(3)


# ---- line frequency

def plain_judge(rows, max_docs):
    norm = lambda line: re.sub("[0-9]", "0", low(re.sub("[ \t\n\x0b\x0c\r]+", " ", line).strip(" ")))
    holders = defaultdict(set)
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if i is not None and norm(line):
                holders[s, norm(line)].add(i)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        common = [bool(norm(x)) and i is not None and len(holders[s, norm(x)]) > max_docs for x in t.split("\n")]
        lost = sum(len(WORD.findall(x)) for x, c in zip(t.split("\n"), common) if c)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        kept_text = "\n".join(x for x, c in zip(t.split("\n"), common) if not c)
        out.append((i, s, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), lost, failed,
                    not failed and 100 * lost <= 50 * len(w), kept_text))
    return Counter(out)


def host_rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "日本#", "a|b", "<p>", "$5"]
    shared = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 30, 60)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 5, 60]))) for _ in range(rng.randrange(4))]
        lines += [rng.choice([f"  {x.upper()}\t", x, x.replace(" ", "  ")]) for x in shared if rng.random() < .5]
        if rng.random() < .3 and lines:
            lines.append(lines[0])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(60, None, "a"), (61, "", "a"), (62, " \n\t\r\n ", None), (None, shared[1], "a"), (3, rows[3][1], rows[3][2]), (4, rows[5][1], "a"),
             (63, "a b a b a b " * 20, ""), (64, "\n".join(f"line {i}" for i in range(3000)), "b"), (65, "x " * 200_000, "b"), (66, "\n\n" + shared[2], "")]
    return rows


@pytest.mark.parametrize("max_docs", [0, 3, 8])
def test_line_frequency(spark, max_docs):
    rows = host_rows()
    got = line_frequency.judge(frame(spark, rows, "doc_id long, text string, source string"), max_docs=max_docs).collect()
    assert got[0].word == "y" and got[0].phrase == "z"
    names = ["doc_id", "source", *line_frequency._COUNTS, "n_lost_words", "base_failed", "kept", "text"]
    assert Counter(tuple(r[c] for c in names) for r in got) == plain_judge(rows, max_docs)


def test_numbers_of_a_line_do_not_part_it(spark):
    rows = [(i, f"Page {i} of 20\n" + " ".join(f"own{'abcdefghi'[i]}{k}" for k in range(80)), "h") for i in range(9)]
    got = line_frequency.judge(frame(spark, rows, "doc_id long, text string, source string"), max_docs=0).collect()
    assert {r.n_lost_words for r in got} == {84}
    got = line_frequency.judge(frame(spark, rows, "doc_id long, text string, source string"), max_docs=8).collect()
    assert {(r.n_lost_words, r.kept, r.text[:3]) for r in got} == {(4, True, "own")}


# ---- spelling variants

def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def plain_variants(rows):
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += len(run) >= 5
    words = {w: n for w, n in words.items() if n >= 3}
    near = defaultdict(list)
    for x, y in combinations(words, 2):
        if one_edit(x, y):
            near[x].append((-words[y], y))
            near[y].append((-words[x], x))
    form = {w: min(near[w])[1] if w in near and -min(near[w])[0] >= 2 * n else None for w, n in words.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n, len(near[w]) if w in near else 0, form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def spelled_rows():
    rng = random.Random(7)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice("abÀé"[:rng.choice([2, 4])]) for _ in range(rng.choice([4, 5, 5, 6, 6, 7]))) for _ in range(rng.randrange(60))]
        rows.append((i, rng.choice([" ", "-", "1", "日"]).join(rng.choice([w, w.upper(), w]) for w in words)))
    long = "".join(rng.choice("abcdefg") for _ in range(3000))
    rows += [(100 + k, f"{long} {long[:1500]}x{long[1500:]} {long[:-1]} {long[1:]} {long}") for k in range(3)]
    chain = ["steelx"] * 4 + ["steels"] * 9 + ["steelsa"] * 20 + ["steelsab"] * 50 + ["steelsabc"] * 120
    return rows + [(200, " ".join(chain)), (201, None), (202, ""), (203, "12 34"), (None, "aabba " * 5), (5, rows[5][1]), (6, rows[7][1]), (204, "ÀÀÀÀÀ àààààà " * 9), (205, "a×b÷c " * 4)]


@pytest.mark.parametrize("state_words", [1, 5, 20_000])
def test_variants(spark, state_words):
    rows = spelled_rows()
    got = variants.variants(frame(spark, rows, "doc_id long, text string"), state_words=state_words).collect()
    assert len(got) == len({r.word for r in got})
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == plain_variants(rows)
    assert max(len(r.word) for r in got) > 3000


def test_accepted_pairs_come_once():
    a = variants.Acceptor()
    words = sorted({"".join(p) for p in zip("aabbccab", "abcabcba", "aaaabbbb")})
    start = a.compile(words)
    pairs = list(variants.one_replaced(a, start))
    assert len(pairs) == len(set(pairs)) and set(map(frozenset, pairs)) == {frozenset(p) for p in combinations(words, 2) if one_edit(*p)}
    longer = sorted({w[:i] + c + w[i:] for w in words for i in range(4) for c in "ab"})
    pairs = list(variants.one_inserted(a, start, a.compile(longer), at_end=True))
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, y) for x in words for y in longer if one_edit(x, y)}


def test_equal_tails_share_a_state():
    a = variants.Acceptor()
    start = a.compile(sorted(x + y for x in "abcdef" for y in ("xyz", "xyw", "qqq")))
    assert len(set(a.arcs[start].values())) == 1 and len(a.arcs) < 9


# ---- collocations

def plain_collocations(rows, min_count, top):
    f, n = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", low(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        around = [b for (g, v), b in cand.items() if g == lang and len(v) > len(w) and w in (v[:2], v[1:])]
        if any(100 * b >= 50 * a for b in around):
            continue
        score, cut = min((1000000 * a * a // (f[lang, w[:c]] * f[lang, w[c:]]), c) for c in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(all_)[:top], 1)}


def phrase_rows():
    rng = random.Random(3)
    vocab = ["the", "The", "of", "new", "york", "city", "Ünï", "日本", "a\x00b", "x\x1fy", "", "\t", "of the", "new york city", "new york", "hot  dog", " "]
    rows = [(rng.choice(["", ", ", ".", "\n", "\x0b", " "]).join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(9))) for _ in range(6)), rng.choice(["en", "fr", None, ""]))
            for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" \t", "xx"), ("?!", "xx"), rows[4], (" ".join(f"u{i}" for i in range(30000)), "en"), ("to be " * 3000, "fr")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    rows = phrase_rows()
    args = {}
    if small:  # partitions of 2 kB of text
        args = {"partition_bytes": 2000}
    df = frame(spark, rows, "text string, lang string")
    got = collocations.collocations(df, top=25, **args).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, 10, 25) and len(got) > 60


def test_trie_bursts_spills_and_merges(monkeypatch):
    for name, value in (("CONTAINER", 16), ("TRIE_PHRASES", 300), ("TRIE_WORDS", 40), ("STRETCH", 11)):
        monkeypatch.setattr(collocations, name, value)
    import pyarrow as pa
    rows = phrase_rows()[:40]
    batch = pa.record_batch([pa.array([g or "und" for _, g in rows]), pa.array([t for t, _ in rows])], ["lang", "text"])
    runs = [r for b in collocations._count_batches([batch], 7) for r in b.to_pylist()]
    assert len(runs) > 50
    found = Counter()
    for lang, part in {(r["lang"], r["part"]) for r in runs}:
        phrases, total = collocations._merge([(r["n"], r["size"], r["lengths"], r["counts"], r["body"]) for r in runs if (r["lang"], r["part"]) == (lang, part)])
        for p, t in zip(phrases.to_pylist(), total):
            assert (lang, p) not in found
            found[lang, p] = int(t)
    want = Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i:i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert found == want


def test_bursts_follow_the_levels():
    trie = collocations.Trie()
    keys = np.unique((np.arange(1, 9, dtype=np.uint64)[:, None] << np.uint64(42)) | (np.arange(1, 20001, dtype=np.uint64) << np.uint64(21)))
    trie.add(keys, np.ones(len(keys), np.int64))
    assert len(trie.leaves) == 8 and all((leaf.low >> 21) % (1 << 21) == 1 for leaf in trie.leaves[1:])  # one first word in each
    trie.add(keys + np.uint64(1), np.ones(len(keys), np.int64))
    assert len(trie.leaves) == 16 and all(leaf.low % (1 << 21) == 0 for leaf in trie.leaves)  # halves of a first word's second words
    keys = np.sort(np.concatenate([keys, keys + np.uint64(1)]))
    got = np.sort(np.concatenate([leaf.items()[0] for leaf in trie.leaves]))
    assert np.array_equal(got, keys) and trie.size == len(keys)


def test_empty_tables(spark):
    docs = prepare(spark).createDataFrame([], "doc_id long, text string, lang string, source string")
    assert line_frequency.judge(docs).count() == variants.variants(docs).count() == collocations.collocations(docs).count() == 0
