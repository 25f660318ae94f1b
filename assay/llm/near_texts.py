"""Near-deduplication by shingle similarity: SimHash tries first, then buckets, each link checked.

Two texts are near copies if the Jaccard similarity of their sets of ``SHINGLE``-word shingles
is at least ``SIMILARITY``. Texts with equal sets are one node. Links come from three rounds,
and only those that hold on the shingle sets themselves count:

1. the trie join of SimHash fingerprints (``simhash.near_links``), which joins dense groups
   by few links. At similarity 0.8 two fingerprints differ in about 10 of 64 bits, more than a
   trie walk can take on a large table, so it finds only the closest copies;
2. buckets of nodes with equal minima of ``ROWS`` hashes each, in ``BANDS`` ways. Inside a bucket
   nodes are compared by parity sketches: ``SKETCH_BITS`` bits, each the parity of the shingles
   hashed to it, so that two sketches differ as the sets' symmetric difference does. Pairs that
   are surely similar join components as a forest, a pair for each two components at most;
3. the same buckets again, with the components so found: pairs of different components whose
   sketches leave it open whether they are similar.

So the families whose members are less alike than the limit, though they share buckets, cost
comparisons of 128 bytes inside a task; a row leaves it only for a pair that is, within four
deviations, as similar as asked, and once, in the first bucket that both share. Large buckets are
cut into tiles of about ``TILE`` nodes. Whole sets are on rows only where Spark compares them.

A pair at similarity s shares a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993
at 0.8, over 0.99999 at 0.9. Sets are compared by their 64-bit shingle hashes.

Results for unusual input: null and empty texts have the empty set and are copies of each
other; fewer words than a shingle count as one shingle; rows that repeat share a component; a
component without any doc_id has component_id null, and ``dedup`` keeps one of its rows; no rows
give no rows; other columns are kept by ``dedup`` and else not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import Scratch, each_bytes, text_rows, with_rows
from assay.llm.components import components
from assay.llm.exact_dedup import keep_rows
from assay.llm.simhash import SEED, fingerprint, near_links

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 14
_RANDOM = np.random.default_rng(SEED)
_ADD = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
_CHUNK = 1 << 15
SKETCH_BITS = 1024
#: Sets above this size are sketched by a sample of their hashes, halved until it is below.
SKETCHED = 1024
TILE = 2048
#: Sets that a task hands to Spark at once, and pairs.
SETS_BYTES = 4 << 20
PAIRS_AT_ONCE = 1 << 15
DEVIATIONS = 4.0


def shingle_set(body: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a = starts[:max(1, len(words) - shingle + 1)].tolist()
    b = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's minima."""
    low = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK]
        for i in range(ROWS * BANDS):
            low[i] = min(low[i], ((part ^ _ADD[i]) * _TIMES[i]).min())
    return np.array([xxhash.xxh64_intdigest(low[i:i + ROWS].tobytes(), i) for i in range(0, ROWS * BANDS, ROWS)], np.uint64)


def _signatures(shingle: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, size, prints, bands = [], [], [], []
        for body in each_bytes(batch.column("text")):
            own = shingle_set(body, shingle)
            node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            size.append(len(own))
            prints.append(fingerprint(body, shingle))
            bands.append(minima(own).view(np.int64).tolist())
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("copy"), pa.array(np.array(node, np.uint64).view(np.int64)),
            pa.array(size, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
            pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "copy", "node", "size", "fingerprint", "bands"])
    return with_rows(rows)


def parity_sketch(hashes: np.ndarray, level: int) -> bytes:
    """Parities of the hashes that end with ``level`` zero bits."""
    some = hashes[(hashes & np.uint64((1 << level) - 1)) == 0] if level else hashes
    counts = np.bincount((some >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def level_of(size: int) -> int:
    return max(0, (size - 1).bit_length() - (SKETCHED - 1).bit_length())


def _differing(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the differing bits of sketches whose sets differ in ``d`` hashes."""
    return SKETCH_BITS / 2 * -np.expm1(-2 * d / SKETCH_BITS), np.minimum(d * np.sqrt(2 / SKETCH_BITS), np.sqrt(SKETCH_BITS) / 2)


def bit_limits(sizes: np.ndarray, level: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits up to which pairs of ``sizes`` (both together) are surely, or perhaps, similar."""
    share = 0.5 ** level
    most = sizes * (1 - similarity) / (1 + similarity) * share
    spread = DEVIATIONS * np.sqrt(most * (1 - share))
    mean, deviation = _differing(np.maximum(most - spread, 0))
    open_mean, open_deviation = _differing(most + spread)
    return mean - DEVIATIONS * deviation, open_mean + DEVIATIONS * open_deviation


def _sets(shingle: int):
    names = ["node", "own", "level", "s0", "s1"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for node, body in zip(batch.column("node").to_pylist(), each_bytes(batch.column("text"))):
                own = shingle_set(body, shingle)
                level = level_of(len(own))
                rows.append((node, own.view(np.int64), level, *[parity_sketch(own, level + more) for more in (0, 1)]))
                size += own.nbytes
                if size > SETS_BYTES:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)
    return run


class _Cell:
    """Nodes of one tile, or of two, of one bucket."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.band, self.bands = int(rows["band"][0]), rows["bands"]
        self.node, self.size, self.level, self.side = (rows[c] for c in ("node", "size", "level", "side"))
        self.label, self.bits = rows["label"].copy(), [rows["s0"], rows["s1"]]

    def pairs(self, similarity: float, sure: bool):
        """Pairs of different labels, node by node; if ``sure``, labels are merged as pairs are found."""
        crossed = bool(self.side.any())
        first = np.flatnonzero(self.side == 0)
        for i in range(len(self.node)):
            if crossed and not self.side[i]:
                continue
            of = first if crossed else np.arange(i)
            sizes = self.size[of]
            of = of[(self.label[of] != self.label[i]) & (np.minimum(sizes, self.size[i]) >= similarity * np.maximum(sizes, self.size[i]))]
            of = of[np.argmax(self.bands[of] == self.bands[i], axis=1) == self.band] if len(of) else of
            if not len(of):
                continue
            level = np.maximum(self.level[of], self.level[i])
            theirs = np.where((self.level[of] == level)[:, None], self.bits[0][of], self.bits[1][of])
            mine = np.where((self.level[i] == level)[:, None], self.bits[0][i], self.bits[1][i])
            n = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
            limit = bit_limits(self.size[of] + self.size[i], level.astype(np.float64), similarity)[0 if sure else 1]
            of = of[n <= limit]
            if sure and len(of):
                labels, at = np.unique(self.label[of], return_index=True)
                of = of[at]
                self.label[np.isin(self.label, labels)] = self.label[i]
            if len(of):
                yield np.full(len(of), self.node[i]), self.node[of]


def _pairs_of_cells(similarity: float, sure: bool):
    """Rows come sorted by cell; pairs go as they are found, so that a dense cell is never held in pairs."""
    cell = ["band", "key", "ti", "tj"]

    def columns(batch):
        n = batch.num_rows
        out = {c: batch.column(c).to_numpy() for c in (*cell, "node", "label", "size", "level", "side")}
        out["bands"] = batch.column("bands").flatten().to_numpy().reshape(n, -1)
        return out | {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, -1) for c in ("s0", "s1")}

    def cells(batches):
        """The columns of one cell after the other."""
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            cuts = (np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in cell], axis=0)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if at != (at := tuple(rows[c][i] for c in cell)) and held:
                    yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                    held = []
                held.append({c: x[i:j] for c, x in rows.items()})
        if held:
            yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    def table(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])

    def run(batches):
        a, b, n = [], [], 0
        for rows in cells(batches):
            if len(rows["node"]) < 2:
                continue
            for x, y in _Cell(rows).pairs(similarity, sure):
                a.append(x)
                b.append(y)
                n += len(x)
                if n > PAIRS_AT_ONCE:
                    yield table(a, b)
                    a, b, n = [], [], 0
        if n:
            yield table(a, b)
    return run


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose shingle sets are similar enough.

    Spark compares the sets itself: two of them stand on each row, too much to hand to Python in batches.
    """
    pairs = scratch.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b"))
    both = F.size(F.array_intersect("x", "y"))
    links = scratch.cut(rows.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b"))
    scratch.free(pairs)
    return links


def _labelled(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with the component that the links give each of them."""
    roots = components(links)
    return scratch.cut(nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))


def _print_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Node pairs of the trie join; nodes of one fingerprint against the smallest of them."""
    heads = scratch.cut(nodes.groupBy("fingerprint").agg(F.min("node").alias("head")))
    of = nodes.select("node", "fingerprint").join(heads, "fingerprint").filter("node != head")
    links = near_links(heads.select("fingerprint"))
    a, b = (heads.select(F.col("fingerprint").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    return of.select(F.col("node").alias("a"), F.col("head").alias("b")).union(
        links.join(a, "a").join(b, "b").select("head_a", "head_b"))


def _mixed(nodes: DataFrame) -> DataFrame:
    """node, label, size, bands, band, key, n: rows of the buckets with more than one component."""
    rows = nodes.select("node", "label", "size", "bands", F.posexplode("bands").alias("band", "key"))
    mixed = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(mixed.filter("low < high").select("band", "key", "n"), ["band", "key"])


def _bucket_pairs(nodes: DataFrame, sets: DataFrame, similarity: float, sure: bool) -> DataFrame:
    """Pairs (a, b) of the buckets whose sketches are close enough."""
    rows = _mixed(nodes).join(sets.select("node", "level", "s0", "s1"), "node")
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cell = ["band", "key", "ti", "tj"]
    rows = rows.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other"),
                             "side": (F.col("tile") > F.col("other")).cast("long")})
    return rows.select(*cell, "node", "label", "size", "level", "side", "s0", "s1", "bands").repartition(*cell).sortWithinPartitions(
        *cell, "node").mapInArrow(_pairs_of_cells(similarity, sure), "a long, b long")


def _labels(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, copy (hash of the text), node of each row; node, label of each node."""
    scratch = Scratch(docs.sparkSession)
    rows = text_rows(docs).withColumn("copy", F.xxhash64("text"))
    signed = scratch.cut(rows.mapInArrow(
        _signatures(shingle), "doc_id long, copy long, node long, size long, fingerprint long, bands array<long>"))
    nodes = scratch.cut(signed.groupBy("node").agg(*[F.min(c).alias(c) for c in ("copy", "size", "fingerprint", "bands")])
                        .withColumn("label", F.col("node")))
    pairs = scratch.cut(_print_pairs(nodes, scratch))
    # Sets are made once, and only for nodes that can be in a pair.
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(_mixed(nodes).select("node")).distinct()
    texts = rows.groupBy("copy").agg(F.any_value("text").alias("text"))
    sets = scratch.cut(texts.join(nodes.join(used, "node").select("copy", "node"), "copy").select("node", "text")
                       .mapInArrow(_sets(shingle), "node long, own array<long>, level long, s0 binary, s1 binary"))
    links = _checked(pairs, sets, similarity, scratch)
    nodes = _labelled(nodes.drop("label"), links, scratch)
    for sure in (True, False):
        links = links.union(_checked(_bucket_pairs(nodes, sets, similarity, sure), sets, similarity, scratch))
        nodes = _labelled(nodes.drop("label"), links, scratch)
    scratch.free_all_but(signed, nodes)
    return signed.select("doc_id", "copy", "node"), nodes.select("node", "label")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest doc_id of its near copies)."""
    signed, nodes = _labels(docs, shingle, similarity)
    first = signed.groupBy("node").agg(F.min("doc_id").alias("first"))
    of = nodes.join(first, "node")
    smallest = of.groupBy("label").agg(F.min("first").alias("component_id"))
    return signed.select("doc_id", "node").join(of.join(smallest, "label").select("node", "component_id"), "node").select(
        "doc_id", "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they are."""
    signed, nodes = _labels(docs, shingle, similarity)
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "copy")
    best = signed.groupBy("node").agg(F.min(row).alias("row")).join(nodes, "node").groupBy("label").agg(F.min("row").alias("row"))
    return keep_rows(docs, best.select("row.doc_id", "row.copy"))
