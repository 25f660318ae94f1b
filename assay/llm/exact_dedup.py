"""Exact deduplication with an extendible-hash index on shared files.

The keys are XXH64 values of the normalised texts (A-Z lower-cased, null = empty). A
histogram over the top ``MAX_DEPTH`` bits, at most 2**MAX_DEPTH counters however large the
input is, gives the directory: it starts with one bucket, splits each overfull bucket by its
next bit, and doubles whenever a bucket outgrows the global depth. Buckets are ranges of keys.
Each owner task receives whole buckets, sorted by key. Texts with equal keys form a chain, in
which every arriving text is compared byte by byte. A bucket that cannot be split further
(one hot key) is still read as a sorted stream: memory holds one chain, not the bucket.
Equal texts inside one input partition are merged before the shuffle, so a group that holds a
third of all rows reaches its owner as one row per input partition.

Results for unusual input: null text counts as empty, and all empty texts are one group; rows
that repeat a doc_id and text are copies of which one stays; a group without any doc_id keeps
one row and has keep_id null; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.common import cut_lineage, each_bytes, free_name, shuffle_parts, text_rows, with_rows

#: The directory has at most 2**MAX_DEPTH entries: 1,048,576.
MAX_DEPTH = 20
BUCKET_BYTES = 16 << 20
#: Texts that a map task holds for merging before it passes them on.
MERGE_BYTES = 32 << 20
_LOW = -(1 << 63)


@dataclass
class Directory:
    """``bucket[p]`` is the bucket of the keys whose top ``depth`` bits are ``p``."""

    depth: int
    bucket: np.ndarray
    local_depth: np.ndarray
    load: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.local_depth)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        return self.bucket[(keys.astype(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]

    def owners(self, n: int) -> np.ndarray:
        """Contiguous runs of buckets with about equal bytes, one run for each of n owners."""
        before = np.cumsum(self.load) - self.load
        return np.minimum(before * n // max(1, int(self.load.sum())), n - 1).astype(np.int64)


def build_directory(loads: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Split overfull buckets bit by bit; ``loads`` has bytes by the top ``max_depth`` bits."""
    fine = np.zeros(1 << max_depth, np.int64)
    for prefix, size in loads.items():
        fine[prefix] += size
    depth, level, done = 0, [0], []
    while level:
        sums = fine.reshape(1 << depth, -1).sum(axis=1)
        split = [p for p in level if sums[p] > capacity and depth < max_depth]
        done += [(depth, p, int(sums[p])) for p in set(level) - set(split)]
        level = [c for p in split for c in (2 * p, 2 * p + 1)]
        depth += bool(level)
    done.sort(key=lambda b: b[1] << (depth - b[0]))
    bucket = np.repeat(np.arange(len(done)), [1 << (depth - d) for d, _, _ in done])
    return Directory(depth, bucket, np.array([d for d, _, _ in done]), np.array([s for _, _, s in done]))


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sizes, digests = [], [], []
    for text in each_bytes(batch.column("text")):
        text = text.lower()
        keys.append(xxhash.xxh64_intdigest(text))
        sizes.append(len(text))
        digests.append(hashlib.sha256(text).hexdigest())
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64)),
        pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
    ], ["doc_id", "key", "n_bytes", "text_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes and text_sha256 of each row."""
    return text_rows(docs).mapInArrow(with_rows(_keys), "doc_id long, key long, n_bytes long, text_sha256 string")


def _merged(directory: Directory, n_owners: int, merge_bytes: int):
    """Map side: one row for each distinct text of the batches held."""
    owners = directory.owners(n_owners)

    def flush(held):
        keys = np.array([xxhash.xxh64_intdigest(t) for t in held], np.uint64)
        buckets = directory.of(keys)
        return pa.RecordBatch.from_arrays([
            pa.array(owners[buckets].astype(np.int32)), pa.array(buckets), pa.array(keys.view(np.int64)),
            pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
            pa.array([v[1] for v in held.values()], pa.int64()),
        ], ["owner", "bucket", "key", "body", "keep_id", "group_size"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), each_bytes(batch.column("text"))):
                body = body.lower()
                old = held.get(body)
                if old is None:
                    held[body] = [doc_id, 1]
                    size += len(body) + 200
                else:
                    old[1] += 1
                    if old[0] is None or doc_id is not None and doc_id > old[0]:
                        old[0] = doc_id
                if size > merge_bytes:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)
    return run


def _chains(local_depth: np.ndarray):
    """Owner side: rows arrive sorted by bucket and key; a chain holds the texts of one key."""
    def close(at, chain, out):
        for i, (body, (keep, size)) in enumerate(chain.items()):
            out.append((at[0], int(local_depth[at[0]]), at[1], i, hashlib.sha256(body).hexdigest(), keep, size))

    def batch_of(out):
        names = ["bucket", "local_depth", "key", "chain", "text_sha256", "keep_id", "group_size"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches):
        at, chain, out = None, {}, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "key", "body", "keep_id", "group_size")]
            for bucket, key, body, keep, size in zip(*cols):
                if (bucket, key) != at:
                    if at is not None:
                        close(at, chain, out)
                    at, chain = (bucket, key), {}
                    if len(out) >= 8192:
                        yield batch_of(out)
                        out = []
                old = chain.get(body)  # a dictionary finds an entry only if the bytes are equal
                chain[body] = (keep, size) if old is None else (
                    keep if old[0] is None else old[0] if keep is None else max(old[0], keep), old[1] + size)
        if at is not None:
            close(at, chain, out)
        if out:
            yield batch_of(out)
    return run


INDEX = "bucket long, local_depth int, key long, chain int, text_sha256 string, keep_id long, group_size long"


def build_index(docs: DataFrame, keys: DataFrame, bucket_bytes: int = BUCKET_BYTES,
                max_depth: int = MAX_DEPTH, merge_bytes: int = MERGE_BYTES) -> tuple[DataFrame, Directory]:
    """The index as a table on shared files, one row for each distinct text, and its directory."""
    loads = keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("p")).agg(F.sum("n_bytes").alias("n"))
    directory = build_directory({r.p: r.n for r in loads.collect()}, bucket_bytes, max_depth)
    owners = max(shuffle_parts(docs), min(directory.buckets, 1 << 16))
    merged = text_rows(docs).mapInArrow(
        _merged(directory, owners, merge_bytes),
        "owner int, bucket long, key long, body binary, keep_id long, group_size long")
    index = (merged.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key")
             .mapInArrow(_chains(directory.local_depth), INDEX))
    return cut_lineage(index), directory


def groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = cut_lineage(keyed(docs))
    index, _ = build_index(docs, keys, bucket_bytes)
    several = index.filter("group_size > 1").select("key", "text_sha256", "keep_id", "group_size")
    found = keys.drop("n_bytes").join(several, ["key", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1)))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (turn == 1)).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names; repeated rows of one document once.

    Rows are named by doc_id and, if ``kept`` has it, by text_sha256 of the normalised text or by
    ``copy``, a hash of the text as it is: of rows without doc_id only those of a kept text stay.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else None
    names = {"text_sha256": lambda: F.sha2(lower_ascii(text), 256), "copy": lambda: F.xxhash64(text)}
    used = [] if text is None else [n for n in names if n in kept.columns]
    own = {n: free_name(f"__{n}", docs) for n in used}
    ids = kept.select(F.col("doc_id").cast("long").alias("doc_id"), *used).distinct().alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    for n in used:
        same &= F.col(f"d.{own[n]}") == F.col(f"k.{n}")
    found = docs.withColumns({own[n]: names[n]() for n in used}) if used else docs
    found = found.alias("d").join(ids, same, "left_semi")
    if text is None:
        return found
    turn = free_name("__turn", docs)
    one = Window.partitionBy("doc_id", *(own.values() if used else ["text"])).orderBy("text")
    return found.withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*docs.columns)


def lower_ascii(text: Column) -> Column:
    """A-Z alone lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    return keep_rows(docs, groups(docs).filter("kept"))
