"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and grouping by union-find.

Signatures: every element ranks all slots by a permutation of its own, and its value at the slot of rank ``j`` is ``j`` plus
a fraction. A text stops after the first rank at which all slots hold less than the next rank; long texts need one.
Copies of one shingle set are one class. Class heads that share a band's key are compared in rounds, and after each the
groups are merged: first all with the smallest head of their bucket; then, while this finds links and buckets span several
groups, each head with its nearest signature in another group; at last all remaining pairs of different groups whose
signatures are near. The later rounds look at pairs block by block inside tasks. One pair for each head, and in the last
round only true links, leave them. Every link is confirmed on the whole shingle sets. A pair at the threshold is missed by chance alone: by banding below 6e-6
(less above the threshold), by signatures below 3e-7.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.llm import words as W
from leadvane.llm.common import keyed, written

U = np.uint64


@dataclass(frozen=True)
class NearSpec:
    shingle: int = 5
    percent: int = 75
    slots: int = 256
    #: The first so many slots form bands of ``rows`` slots.
    banded: int = 128
    rows: int = 4
    #: Members of one bucket that one cell compares with as many others, by signatures and by full sets.
    block: int = 1024
    set_block: int = 256

    @property
    def bands(self) -> int:
        return self.banded // self.rows

    @property
    def least_agreement(self) -> int:
        """Equal slots of a linked pair: the mean at the threshold less five standard deviations."""
        p = self.percent / 100
        return int(self.slots * p - 5 * (self.slots * p * (1 - p)) ** 0.5)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, text after text, and where each text begins."""
    data = W.LOWER[data]
    start, end, first = W.split(data, off)
    word = W.word_hashes(data, start, end)
    at, text = W.windows(word, first, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    h = np.concatenate([W.run_hash(word, at, at + k), W.run_hash(word, first[:-1][short], first[1:][short])])
    text = np.concatenate([text, short])
    if len(short):
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(off)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def super_minhash(h: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (texts x slots): upper 32 bits the rank, lower 32 bits the fraction of the smallest value of each slot."""
    texts = len(first) - 1
    sig = np.full(texts * slots, ~U(0))
    text = np.repeat(np.arange(texts), np.diff(first))
    perm = None
    for j in range(slots):
        if not len(h):
            break
        draw = W.mix(h + U((j * 0xD1B54A32D192ED03 + 1) & (2 ** 64 - 1)))
        k = j + ((draw >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)
        value = (draw & U(0xFFFFFFFF)) | U(j << 32)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(h))
            slot = perm[row, k].astype(np.int64)
        np.minimum.at(sig, text * slots + slot, value)
        live = sig.reshape(texts, slots).max(axis=1) >= U((j + 1) << 32)
        more = live[text]
        h, text, k, slot = h[more], text[more], k[more], slot[more]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
        else:
            perm = perm[more]
        row = np.arange(len(h))
        perm[row, k] = perm[row, j]
        perm[row, j] = slot
    return sig.reshape(texts, slots)


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), -1, rows)
    key = np.tile(np.arange(parts.shape[1], dtype=U), (len(sig), 1))
    for r in range(rows):
        key = W.mix(key ^ parts[:, :, r])
    return key


def sketches(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """doc_id, n_shingles, 128-bit fingerprint of the set (f1, f2), band keys and one byte of each signature slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                h, first = shingle_sets(data, off, spec.shingle)
                n = np.diff(first)
                sums = [np.concatenate([[U(0)], np.cumsum(W.mix(h ^ U(c)), dtype=U)]) for c in (0, 0x5851F42D4C957F2D)]
                f1, f2 = (s[first[1:]] - s[first[:-1]] for s in sums)
                sig = super_minhash(h, first, spec.slots)
                keys = _band_keys(sig[:, :spec.banded], spec.rows)
                keys_off = np.concatenate([[0], np.cumsum(np.where(n > 0, spec.bands, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(keys_off, W.longs(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), W.longs(f1), W.longs(f2), bands, W.binary(W.mix(sig).astype(np.uint8))],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary")


def _likely(pairs: DataFrame, heads: DataFrame, spec: NearSpec) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree in enough slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in (2, 3))
                ok = (x == y).sum(axis=1) >= spec.least_agreement
                yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], names=["a", "b"])
    one = heads.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    two = heads.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * spec.percent
    return pairs.join(two, "b").join(one, "a").where(fit).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, spec: NearSpec) -> DataFrame:
    """doc_id, words: the packed sorted shingle hashes of the documents of the written table ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                h, first = shingle_sets(data, off, spec.shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), W.ragged_binary(h, first)], names=["doc_id", "words"])
    return keyed(docs.select(F.col("doc_id").cast("long"), "text"), ids).mapInArrow(run, "doc_id long, words binary")


def confirmed(pairs: DataFrame, docs: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs (a, b) of the written table ``pairs`` whose full shingle sets reach the similarity."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= spec.percent * (len(both) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    sets = written(_sets(docs, ids, spec), "near-sets")
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("words").alias("wb")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(compare, "a long, b long").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: at most one edge to the smallest member for each node leaves."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for t in batches:
        for x, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if root[x] != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges (a, b) that is not itself the smallest.

    Union-find contracts the edges inside each partition; then rounds of star contraction between partitions, each
    written to the shared folder, until the edges are stars. Nothing of the graph reaches the driver.
    """
    def sized(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())

    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .mapInArrow(_contract, "u long, v long").distinct(), "star")
    state = sized(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        e = written(small.distinct(), "star")
        last, state = state, sized(e)
        if last == state:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _by_cell(find) -> Callable:
    """Rows come sorted by cell (key, bi, bj), which may span batches; ``find(cell)`` gives its pairs (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            x, y = find(t)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            key, bi, bj = (t.column(c).to_numpy() for c in ("key", "bi", "bj"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            at = 0
            for c in cut.tolist():
                yield from emit(t.slice(at, c - at))
                at = c
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield from emit(held)
    return run


def _partners(t: pa.Table, spec: NearSpec, ordered: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a cell: rows of other groups with a fitting size and a near signature, and their equal slots.

    A cell of one block compares all its rows (``ordered``: each pair once), one of two blocks the first with the second.
    """
    comp, n, blk = (t.column(c).to_numpy() for c in ("comp", "n_shingles", "blk"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    first, last = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
    for x in range(len(n)):
        if first == last:
            y = np.arange(x + 1 if ordered else 0, len(n))
        else:
            y = np.flatnonzero(blk != blk[x]) if blk[x] == first or not ordered else np.zeros(0, np.int64)
        y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= spec.percent * np.maximum(n[y], n[x]))]
        if len(y):
            same = (sig[y] == sig[x]).sum(axis=1)
            near = same >= spec.least_agreement
            if near.any():
                yield x, y[near], same[near]


def _nearest(spec: NearSpec):
    """Each row of a cell with the nearest signature of another group."""
    def find(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("doc_id").to_numpy()
        found = [(x, y[same.argmax()]) for x, y, same in _partners(t, spec, False)]
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return ids[x], ids[y]
    return find


def _links(spec: NearSpec):
    """All pairs of a cell whose full sets reach the similarity; a pair is tested in the first band that it shares."""
    def find(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, key = t.column("doc_id").to_numpy(), t.column("key")[0].as_py()
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(w.as_buffer(), U) for w in t.column("words")]
        xs, ys = [], []
        for x, y, _ in _partners(t, spec, True):
            before = np.argmax(bands[x] == key)
            y = y[~(bands[y, :before] == bands[x, :before]).any(axis=1)]
            for k in range(0, len(y), 64):
                part = y[k:k + 64]
                many = np.concatenate([sets[i] for i in part])
                n = np.array([len(sets[i]) for i in part])
                at = np.minimum(np.searchsorted(sets[x], many), len(sets[x]) - 1)
                common = np.add.reduceat((sets[x][at] == many).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
                part = part[100 * common >= spec.percent * (n + len(sets[x]) - common)]
                xs.append(np.full(len(part), x))
                ys.append(part)
        x, y = (ids[np.concatenate(v).astype(np.int64)] if v else np.zeros(0, np.int64) for v in (xs, ys))
        return x, y
    return find


def _cells(label: DataFrame, block: int) -> DataFrame:
    """key, bi, bj, blk, doc_id, comp: members of buckets that span several groups, dealt out in cells of two blocks."""
    rows = label.select("doc_id", "comp", F.explode("bands").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("g"))
    mixed = mixed.where(F.col("c0") != F.col("c1")).select("key", F.ceil(F.col("g") / block).cast("int").alias("nb"))
    return (rows.join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "doc_id", "comp"))


def _labelled(heads: DataFrame, groups: DataFrame) -> DataFrame:
    named = heads.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return written(named.withColumn("comp", F.coalesce("component", "doc_id")).drop("component"), "near-label")


def _dealt(cells: DataFrame, find) -> DataFrame:
    return (cells.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "doc_id")
            .mapInArrow(_by_cell(find), "a long, b long").distinct())


def _nearest_pairs(label: DataFrame, spec: NearSpec) -> DataFrame:
    rows = _cells(label, spec.block).join(label.select("doc_id", "n_shingles", "sig"), "doc_id")
    return _dealt(rows.select("key", "bi", "bj", "blk", "doc_id", "comp", "n_shingles", "sig"), _nearest(spec))


def _remaining_links(label: DataFrame, docs: DataFrame, spec: NearSpec) -> DataFrame:
    """Links between groups, confirmed inside the cells, to which each member's full set is sent."""
    cells = written(_cells(label, spec.set_block), "near-cells")
    sets = _sets(docs, written(cells.select("doc_id").distinct(), "near-ids"), spec).withColumn("n_shingles", (F.octet_length("words") / 8).cast("long"))
    rows = cells.join(label.select("doc_id", "sig", "bands", "n_shingles").join(sets, ["doc_id", "n_shingles"]), "doc_id")
    return _dealt(rows.select("key", "bi", "bj", "blk", "doc_id", "comp", "n_shingles", "sig", "bands", "words"), _links(spec))


def near_groups(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by 5-word shingle sets.

    A text without words (or null) has an empty set and is linked with nothing. Rows that repeat a doc_id are one
    document: a link of any of them links it. A null doc_id takes no part: its component_id is null and it is kept.
    An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(sketches(docs, spec), "near-base")
    real = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("head")), "near-classes")
    heads = real.join(classes.select("f1", "f2", F.col("head").alias("doc_id")), ["f1", "f2", "doc_id"]).select("doc_id", "n_shingles", "bands", "sig")
    heads = written(heads.dropDuplicates(["doc_id", "n_shingles", "sig"]), "near-heads")

    rows = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where(F.col("a") < F.col("z")).select("key", "a")
    stars = rows.join(buckets, "key").where(F.col("doc_id") > F.col("a")).select("a", F.col("doc_id").alias("b")).distinct()
    stars = written(_likely(stars, heads, spec), "near-stars")
    edges = written(confirmed(stars, docs, spec), "near-edges")
    groups = components(edges)

    tested, more = stars, True
    while more:
        label = _labelled(heads, groups)
        pairs = written(_nearest_pairs(label, spec).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        new = written(confirmed(pairs, docs, spec), "near-edges")
        tested, more = tested.union(pairs), new.limit(1).count() > 0
        if more:
            edges = edges.union(new)
            groups = components(edges)
    edges = edges.union(written(_remaining_links(label, docs, spec), "near-edges"))

    members = real.join(classes, ["f1", "f2"]).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    groups = components(edges.union(members)).withColumnRenamed("node", "doc_id")

    out = base.select("doc_id", "n_shingles").join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
