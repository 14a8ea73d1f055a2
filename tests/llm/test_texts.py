"""Line, substring and suffix-array dedup, decontamination, pieces and language id next to plain Python on odd small tables."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadvane.llm import decontam, fst, langid, line_dedup, queries, substring, suffix_array
from leadvane.llm.common import prepare

MODEL = queries.MODEL_FILE
WORD = re.compile("[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, part int, lines string, n_words int, rejected string"


def frame(spark, rows):
    return prepare(spark).createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], DOC).repartition(3)


def passages(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "日本", "a|b", "."]
    shared = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 40, 80]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocab) for _ in range(rng.randrange(20))] + (rng.choice(shared) if rng.random() < .7 else [])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[3][1]), (rows[5][0], rows[5][1]), (n + 3, " ".join(f"u{i % 997}x{i}" for i in range(30000))), (n + 4, rows[7][1])]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_lines(spark):
    rows = [(1, "The same line here\n  x \nTHE SAME LINE HERE  "), (2, "\tthe same line here\x0b\nown line of two\nshort"), (3, "short\nthe same line here\n\nshort"), (4, None), (5, ""),
            (6, "the same line here"), (None, "the same line here"), (2, "own line of two, again"), (7, "Äquator line\näquator line\nown line of two"), (8, "Äquator line"), (9, "\n\n"), (6, "the same line here")]
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(strip(line)) >= 10:
                holders[strip(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i == min(holders[strip(x)], default=i) or len(strip(x)) < 10]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert "source" not in got.columns and {"doc_id", "text", "n_lines", "n_dropped", "n_words"} <= set(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert line_dedup.dedup_lines(frame(spark, rows[:0])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = passages(seed)
    seen = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            if i is not None:
                seen[tuple(w[p:p + 13])].add(i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {q for p in range(len(w) - 12) if i is not None and min(seen[tuple(w[p:p + 13])]) < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in got) > 100
    assert substring.remove_repeats(frame(spark, rows[:0])).collect() == []


@pytest.mark.parametrize("seed", [1, 3])
def test_suffixes(spark, seed):
    spec = suffix_array.SuffixSpec(min_words=20, gram=3, width=10)
    rows = passages(seed)
    must, may = spec.min_words + spec.width - 1, spec.min_words
    words = {(i, t): WORD.findall(t or "") for i, t in rows}

    def covered(size):
        holders = defaultdict(set)
        for (i, _), w in words.items():
            for p in range(len(w) - size + 1):
                if i is not None:
                    holders[tuple(w[p:p + size])].add(i)
        return {k: {q for p in range(len(w) - size + 1) if k[0] is not None and len(holders[tuple(w[p:p + size])]) > 1 for q in range(p, p + size)} for k, w in words.items()}
    low, high = covered(must), covered(may)
    got = suffix_array.repeated_passages(frame(spark, rows), spec).collect()
    assert len(got) == len(rows)
    bounds = defaultdict(list)
    for k in words:
        bounds[k[0], len(words[k])].append((low[k], high[k]))
    for r in got:
        mine = {q for s in r.spans for q in range(s.start, s.stop)}
        assert len(mine) == r.n_repeated and any(a <= mine <= b for a, b in bounds[r.doc_id, r.n_words]), r.doc_id
    assert sum(r.n_repeated for r in got) > 100
    assert suffix_array.repeated_passages(frame(spark, rows[:0])).collect() == []


def test_suffixes_find_a_passage_of_51_words(spark):
    rng = random.Random(5)
    shared = [f"s{rng.randrange(10 ** 6)}" for _ in range(51)]
    rows = [(i, " ".join([f"{i}a{k}" for k in range(rng.randrange(200))] + (shared if i % 3 == 0 else []) + [f"{i}b{k}" for k in range(50)])) for i in range(12)]
    got = {r.doc_id: r.n_repeated for r in suffix_array.repeated_passages(frame(spark, rows)).collect()}
    assert got == {i: 51 if i % 3 == 0 else 0 for i in range(12)}


def repeated_words(rows, size):
    """Words of each document inside a run of ``size`` words that another document holds."""
    words, holders = {i: WORD.findall(t) for i, t in rows}, defaultdict(set)
    for i, w in words.items():
        for p in range(len(w) - size + 1):
            holders[tuple(w[p:p + size])].add(i)
    return {i: {q for p in range(len(w) - size + 1) if len(holders[tuple(w[p:p + size])]) > 1 for q in range(p, p + size)} for i, w in words.items()}


def test_suffixes_meet_every_partner_of_overlapping_excerpts(spark):
    """A = x P q, B = P, D = (last 40 words of P) q: the longest neighbour of a start is not the one that repeats it."""
    rng, rows = random.Random(7), []
    for case in range(60):
        fresh = lambda n: [f"{case}v{rng.randrange(10 ** 9)}" for _ in range(n)]
        passage, tail = fresh(55), fresh(40)
        for text in (fresh(20) + passage + tail, passage, passage[-40:] + tail):
            rows.append((len(rows), " ".join(text)))
    want = repeated_words(rows, 50)
    got = suffix_array.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id: {q for s in r.spans for q in range(s.start, s.stop)} for r in got} == want


def test_suffixes_do_not_depend_on_partitions(spark):
    """A document that repeats a passage inside itself, cut at borders, against a single copy elsewhere."""
    rng, rows = random.Random(9), []
    for case in range(12):
        fresh = lambda n: [f"{case}v{rng.randrange(10 ** 9)}" for _ in range(n)]
        passage = fresh(51)
        rows += [(2 * case, " ".join(sum([passage + fresh(7) for _ in range(40)], []))), (2 * case + 1, " ".join(fresh(9) + passage))]
    want, table = repeated_words(rows, 50), frame(spark, rows)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = suffix_array.repeated_passages(table).collect()
            assert {r.doc_id: {q for s in r.spans for q in range(s.start, s.stop)} for r in got} == want, n
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination(spark):
    lower = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rng = random.Random(4)
    v = [f"t{i}" for i in range(12)] + ["É", "ß"]
    items = [(1, " ".join(rng.choice(v) for _ in range(30))), (2, "Short item, Two"), (3, None), (4, "..."), (5, "one"), (None, "t1 t2"), (1, "another row of item one"), (10, " ".join(rng.choice(v) for _ in range(13)))]
    docs = [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(40)))) for i in range(30)]
    docs += [(40, "x " + items[0][1].upper() + "! y"), (41, "short ITEM two one"), (42, None), (43, ""), (44, " ".join([items[7][1]] * 3)), (45, items[0][1][:90]), (41, "short ITEM two one"), (46, "z " * 5000 + items[7][1]), (47, "ONE")]
    windows = defaultdict(set)
    for i, t in items:
        w = lower(t)
        for p in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows[tuple(w[p:p + 13])].add(str(i))
    want = {}
    for i, t in docs:
        w, hit, found = lower(t), set(), set()
        for p in range(len(w)):
            for n in {len(k) for k in windows}:
                if p + n <= len(w) and tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        want[i] = (len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontam.contamination(d, b).collect()}
    assert got == want
    assert not any(r.contaminated for r in decontam.contamination(d, b.limit(0)).collect())
    assert decontam.contamination(d.limit(0), b).collect() == []


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha beta gamma delta"), (2, "gamma x y alpha"), (3, "alpha " + "z " * 30 + "gamma"), (4, "gamma"), (5, "alpha gamma")])
    phrases = spark.createDataFrame([(7, ["alpha", "gamma"]), (8, ["gamma"]), (9, ["absent", "alpha"])], "phrase long, words array<string>")
    known = decontam.dictionary(spark.createDataFrame([("alpha",), ("gamma",), ("absent",)], "term string"))
    index = decontam.build_index(docs, known)
    near = decontam.proximity_matches(index, known, phrases, 3).collect()
    assert {(r.phrase, r.doc_id) for r in near} == {(7, 1), (7, 2), (7, 5), (8, 1), (8, 2), (8, 3), (8, 4), (8, 5)}
    full = decontam.build_index(docs)
    assert {(r.phrase, r.doc_id, r.start) for r in decontam.phrase_matches(full, known, phrases).collect()} == {(7, 5, 0), (8, 1, 2), (8, 2, 0), (8, 3, 31), (8, 4, 0), (8, 5, 1)}


def test_pieces(spark):
    import sentencepiece

    texts = [None, "", " ", "   ", " a ", "Hello  world é\n\tzz 漢字 🙂", "▁▁a", "x" * 3000, " " * 3000, "Grüße, l'été; 12345.678\r\n" * 50, "def f(x):\n    return x ** 2  # ok", "é", "<s></s><0x0A>"]
    rows = list(enumerate(texts)) + [(1, "again"), (None, "no id")]
    pieces = fst.load(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = fst.verified(fst.decode(fst.encode(frame(spark, rows), pieces), pieces), pieces).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.pieces is None) == (r.text is None) == (r.decoded is None)
        assert r.decoded_same and r.n_words == 2
        if r.text is not None:
            ids = library.encode(r.text)
            assert np.frombuffer(bytes(r.pieces), np.int32).tolist() == ids and r.decoded == library.decode(ids)
    assert fst.encode(frame(spark, []), pieces).collect() == []
    once = fst.round_trip(frame(spark, rows).withColumn("n_pieces", F.lit(-1)), pieces).drop("decoded")
    twice = fst.verified(fst.encode(frame(spark, rows), pieces), pieces).select(*once.columns)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    assert fst.round_trip(frame(spark, []), pieces).collect() == []


def test_weighted_paths_equal_the_best_segmentation():
    texts = ("<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "bb")
    scores = (0.0, -2.0, -2.5, -3.0, -3.2, -4.1, -1.0, -2.2, -5.5)
    machine = fst.Transducer(fst.Pieces(texts, scores, (False,) + (True,) * 8, (), 0, False, True))

    def best(s):
        if not s:
            return 0.0
        return max((scores[i] + best(s[len(t):]) for i, t in enumerate(texts) if i and s.startswith(t)), default=-1e9)
    rng = random.Random(0)
    for _ in range(60):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 10)))
        assert sum(scores[texts.index(t)] for t in machine.path("▁" + s)) == pytest.approx(best("▁" + s))


def test_language(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.learnable(docs))
    judged = langid.predict(docs.where(langid.held_out()), model)
    right = judged.selectExpr("avg(cast(lang = lang_pred AS double)) a", "avg(cast(rejected AS double)) r", "count(*) n").first()
    assert right.n > 100 and right.a > 0.97 and right.r < 0.02
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "漢字"), (5, "the of and"), (None, "der und die"), (5, "the of and"), (6, "la que de " * 20000)]
    got = {(r.doc_id, r.text): r for r in langid.predict(frame(spark, odd), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in odd[:3])
    assert got[odd[3]].lang_pred in model.languages and all(0 <= r.score <= 1 for r in got.values())
    assert got[odd[4]].lang_pred == "en" and got[odd[7]].lang_pred == "es"
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(frame(spark, odd), nothing).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).collect() == []
