"""SimHash near-deduplication by a self-join of binary tries.

Each text becomes a 64-bit fingerprint; two fingerprints link if at most ``MAX_BITS`` bits
differ. The distinct fingerprints stand in binary tries, and node pairs are walked together:
a pair of nodes carries the number of bits in which their paths differ, and is dropped as soon
as that exceeds the budget. To spread the walk, the 64 bits are cut into MAX_BITS + 1 blocks;
linked fingerprints agree in at least one whole block, so there is one trie for each block
that reads that block first, with no error allowed there. Every subtree below a block is a
unit of work. A node pair with more fingerprints than ``PAIR_ROWS`` is walked one level of
``STEP`` bits further in Spark, as new rows keyed by the pairs of children, until all are
small; so no key, however dense, meets in one task.

Inside a task all pairs of a level are expanded at once. Fingerprints that are neighbours in
sorted order and link are joined first, and a pair of subtrees that lie in one such component
is dropped, so a dense group costs links in proportion to its members, not to their pairs. A
task returns, for each fingerprint, its smallest linked one; components are then found on
these links, and no link between different components is lost.

Results for unusual input: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle count as one shingle; rows that repeat share a component; a
component without any doc_id has component_id null; no rows give no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import as_bytes, cut_lineage, text_rows, with_rows
from assay.llm.components import components
from assay.llm.exact_dedup import keep_rows

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of a node pair that one task walks.
PAIR_ROWS = 50_000
#: Bits of a level walked by Spark.
STEP = 8
#: Node pairs that a task holds for one step of the walk.
FRONTIER = 1 << 20
_HASHES = 1 << 17


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = body.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES):
        k = min(_HASHES, n - at)
        a = starts[at:at + k].tolist()
        b = ends[at + min(shingle, len(words)) - 1:][:k].tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])
    return with_rows(rows)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return text_rows(docs).mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long")


def _rotated(value: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    by = np.asarray(by, np.uint64)
    return (value << by) | (value >> ((np.uint64(64) - by) & np.uint64(63))) if np.any(by) else value


def _local_components(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        a, b = label[p], label[q]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def walk(value: np.ndarray, left: np.ndarray, right: np.ndarray, differ: np.ndarray, depth: int,
         max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links below node pairs of a trie.

    ``value`` is sorted within each node; ``left`` and ``right`` are the [begin, end) ranges of
    each pair's nodes at ``depth``; ``differ`` the bits that differ so far.
    """
    n = len(value)
    group = np.zeros(n + 1, np.int64)
    np.add.at(group, np.concatenate((left[:, 0], right[:, 0])), 1)
    group = np.cumsum(group)[:n]
    p, q = [], []
    for turn in range(0, 64, 16):
        order = np.lexsort((_rotated(value, turn), group))
        a, b = order[:-1], order[1:]
        near = (group[a] == group[b]) & (np.bitwise_count(value[a] ^ value[b]) <= max_bits)
        p.append(a[near])
        q.append(b[near])
    label = _local_components(n, np.concatenate(p), np.concatenate(q))
    run = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if n else label
    stack = [(depth, left, right, differ)]
    while stack:
        at, left, right, differ = stack.pop()
        if len(differ) > FRONTIER:
            half = len(differ) // 2
            stack += [(at, left[half:], right[half:], differ[half:]), (at, left[:half], right[:half], differ[:half])]
            continue
        one = (run[left[:, 0]] == run[left[:, 1] - 1]) & (run[right[:, 0]] == run[right[:, 1] - 1])
        one &= label[left[:, 0]] == label[right[:, 0]]
        same = (left == right).all(axis=1)
        live = ~one & ~(same & (left[:, 1] - left[:, 0] == 1))
        leaf = live & (left[:, 1] - left[:, 0] == 1) & (right[:, 1] - right[:, 0] == 1)
        a, b = left[leaf, 0], right[leaf, 0]
        near = np.bitwise_count(value[a] ^ value[b]) <= max_bits
        p.append(a[near])
        q.append(b[near])
        live &= ~leaf
        left, right, differ, same = left[live], right[live], differ[live], same[live]
        if not len(differ) or at == 64:
            continue
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(63 - at)) & np.uint64(1)).astype(np.int64)))
        lm = left[:, 1] - (ones[left[:, 1]] - ones[left[:, 0]])
        rm = right[:, 1] - (ones[right[:, 1]] - ones[right[:, 0]])
        l0, l1 = np.stack((left[:, 0], lm), 1), np.stack((lm, left[:, 1]), 1)
        r0, r1 = np.stack((right[:, 0], rm), 1), np.stack((rm, right[:, 1]), 1)
        other = ~same
        left = np.concatenate((l0, l1, l0, l1[other]))
        right = np.concatenate((r0, r1, r1, r0[other]))
        differ = np.concatenate((differ, differ, differ + 1, differ[other] + 1))
        good = (differ <= max_bits) & (left[:, 0] < left[:, 1]) & (right[:, 0] < right[:, 1])
        stack.append((at + 1, left[good], right[good], differ[good]))
    label = _local_components(n, np.concatenate(p), np.concatenate(q))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _walk_rows(width: int, max_bits: int):
    """Rows sorted by (depth, trie, a, b): whole node pairs are walked, many at once."""
    keys = ["depth", "trie", "a", "b"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for depth, part in rows.groupby("depth", sort=False):
            value = part["value"].to_numpy().view(np.uint64)
            pair = part.groupby(keys[1:], sort=False).ngroup().to_numpy()
            order = np.lexsort((value, pair))
            value, pair, part = value[order], pair[order], part.iloc[order]
            begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            end = np.append(begin[1:], len(pair))
            head = part.iloc[begin]
            a, b = head["a"].to_numpy(), head["b"].to_numpy()
            prefix = (value >> np.uint64(64 - depth)).view(np.int64)
            in_a = np.concatenate(([0], np.cumsum(prefix == np.repeat(a, end - begin))))
            cut = np.where(a == b, end, begin + in_a[end] - in_a[begin])
            left = np.stack((begin, cut), 1)
            right = np.stack((np.where(a == b, begin, cut), end), 1)
            use = (left[:, 0] < left[:, 1]) & (right[:, 0] < right[:, 1])
            x, y = walk(value, left[use], right[use], head["differ"].to_numpy()[use].astype(np.int64),
                        int(depth), max_bits)
            back = (64 - part["trie"].to_numpy().astype(np.uint64) * np.uint64(width)) % np.uint64(64)
            plain = np.where(back == 0, value, (value << back) | (value >> ((np.uint64(64) - back) % np.uint64(64))))
            out.append(pd.DataFrame({"a": plain[x].view(np.int64), "b": plain[y].view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    def run(batches):
        held: list[pd.DataFrame] = []
        size = 0
        for rows in batches:
            held.append(rows)
            size += len(rows)
            if size > 200_000:
                every = pd.concat(held, ignore_index=True)
                last = (every[keys] == every[keys].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield links(every[~last])
                held = [every[last]]
                size = int(last.sum())
        if size:
            yield links(pd.concat(held, ignore_index=True))
    return run


def _masks(step: int, max_bits: int) -> Column:
    """All differences of ``step`` bits within the budget, with their number of bits."""
    every = [sum(1 << i for i in bits) for k in range(max_bits + 1) for bits in itertools.combinations(range(step), k)]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("k")) for m in every])


def _children(pairs: DataFrame, depth: int, step: int, max_bits: int) -> DataFrame:
    """Each fingerprint once for every pair of children that it can belong to."""
    prefix = F.shiftrightunsigned("value", 64 - depth)
    own = F.shiftrightunsigned("value", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    rows = pairs.withColumns({"own": own, "in_a": prefix == F.col("a"), "x": F.explode(_masks(step, max_bits))})
    rows = rows.filter(F.col("differ") + F.col("x.k") <= max_bits)
    other = F.col("own").bitwiseXOR(F.col("x.m"))
    first = F.when(F.col("a") == F.col("b"), F.least("own", other)).when(F.col("in_a"), F.col("own")).otherwise(other)
    second = F.when(F.col("a") == F.col("b"), F.greatest("own", other)).when(F.col("in_a"), other).otherwise(F.col("own"))
    up = lambda c, low: F.shiftleft(c, step).bitwiseOR(low)
    return rows.select("trie", F.lit(depth + step).alias("depth"), up("a", first).alias("a"), up("b", second).alias("b"),
                       (F.col("differ") + F.col("x.k")).alias("differ"), "value")


def near_links(values: DataFrame, max_bits: int = MAX_BITS, pair_rows: int = PAIR_ROWS, step: int = STEP) -> DataFrame:
    """Links (a, b) that connect all distinct ``fingerprint`` values within ``max_bits``."""
    blocks = max_bits + 1
    width = 64 // blocks
    turned = [F.col("fingerprint") if not i else F.shiftleft("fingerprint", i * width).bitwiseOR(
        F.shiftrightunsigned("fingerprint", 64 - i * width)) for i in range(blocks)]
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), t.alias("value")) for i, t in enumerate(turned)]))
    node = F.shiftrightunsigned("t.value", 64 - width)
    todo = values.select(tries.alias("t")).select(
        "t.trie", F.lit(width).alias("depth"), node.alias("a"), node.alias("b"), F.lit(0).alias("differ"), "t.value")
    ready, depth = [], width
    while depth < 64:
        large = (todo.groupBy("trie", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > pair_rows).drop("n"))
        if not large.take(1):
            break
        ready.append(todo.join(large, ["trie", "a", "b"], "left_anti").select(todo.columns))
        bits = min(step, 64 - depth)
        todo = cut_lineage(_children(todo.join(large, ["trie", "a", "b"], "left_semi").select(todo.columns),
                                     depth, bits, max_bits))
        depth += bits
    ready.append(todo)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    return (rows.repartition("trie", "a", "b").sortWithinPartitions("depth", "trie", "a", "b")
            .mapInPandas(_walk_rows(width, max_bits), "a long, b long"))


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct, max_bits, pair_rows)).withColumnRenamed("node", "fingerprint")
    linked = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they are."""
    return keep_rows(docs, groups(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
