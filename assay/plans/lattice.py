"""Group tables of many key sets of one table, without a copy of the rows for each set.

The table is reduced once to its finest key, in which a key value is an 8-byte hash. A task reads
its part of that table in chunks and builds the group tables of all sets there: the classes of a
set come from the stored classes of its prefix and one more column, so a set of three columns costs
one step beyond its pair. What leaves the task are the groups themselves, merged over its chunks;
their partial sums meet in one aggregate. Sets are taken in slices whose groups fit in a task.

``surviving`` leaves out sets before any task sees them. A set has at least as many groups as a
sample of the rows shows, and at least as many as any of its parts, if the other columns are never
NULL; so a part above the limit rules out all sets that hold it, level by level, and exactly.

Keys are told apart by 64-bit hashes. A NULL in a column leaves the row out of the sets with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean
from assay.session import cut_lineage

SAMPLE_ROWS = 4096
#: Below so many sets no sample is drawn.
FEW_SETS = 64
CHUNK_ROWS = 1 << 16
#: Groups that a task may hold, by the sample's groups of each set.
HELD_GROUPS = 2_000_000
#: Sets of one slice at most.
SLICE_SETS = 4096
_P = np.uint64(0x9E3779B97F4A7C15)


def finest(df: DataFrame, columns: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """k0.. (hashes of the key values), n, and s0.., c0.. of each measure, at the finest key."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, m in enumerate(measures):
        v = clean(df, m).cast("double")
        aggs += [F.sum(v).alias(f"s{i}"), F.count(v).alias(f"c{i}")]

    def hashed(c: str) -> Column:
        return F.when(clean(df, c).isNotNull(), F.xxhash64(clean(df, c)))
    return df.groupBy(*[hashed(c).alias(f"k{j}") for j, c in enumerate(columns)]).agg(*aggs)


def _dense(code: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Class numbers from 0 without gaps; -1 stays."""
    if most <= 4 * len(code) + 1024:
        used = np.zeros(most + 1, bool)
        used[code] = True  # -1 marks the last entry, which no class has
        used[most] = False
        number = np.cumsum(used) - 1
        number[most] = -1
        return number[code], int(used.sum())
    values, inverse = np.unique(code, return_inverse=True)
    shift = int(len(values) > 0 and values[0] == -1)
    return inverse - shift, len(values) - shift


class Classes:
    """Class numbers of the rows of a chunk under any set of columns.

    The last set of each width is stored, as sets that share a prefix are asked for in turn.
    """

    def __init__(self, keys: Sequence[np.ndarray], valid: Sequence[np.ndarray]):
        self.rows = len(keys[0]) if keys else 0
        self.keys, self.one = keys, []
        for k, v in zip(keys, valid):
            _, inverse = np.unique(k, return_inverse=True)
            self.one.append(_dense(np.where(v, inverse, -1), int(inverse.max(initial=-1)) + 1))
        self.stored: dict[int, tuple[tuple[int, ...], tuple[np.ndarray, int]]] = {}

    def of(self, members: tuple[int, ...]) -> tuple[np.ndarray, int]:
        if len(members) == 1:
            return self.one[members[0]]
        if self.stored.get(len(members), ((),))[0] != members:
            (a, n), (b, m) = self.of(members[:-1]), self.one[members[-1]]
            self.stored[len(members)] = members, _dense(np.where((a >= 0) & (b >= 0), a * m + b, -1), n * m)
        return self.stored[len(members)][1]

    def codes(self, members: tuple[int, ...], rows: np.ndarray) -> np.ndarray:
        """One hash for the key of each of ``rows``."""
        out = np.zeros(len(rows), np.uint64)
        for j in members:
            out = (out ^ self.keys[j][rows].view(np.uint64)) * _P
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def surviving(sample: Classes, sets: Sequence[tuple[int, ...]], max_groups: int, complete: Iterable[int]
              ) -> tuple[list[int], list[int]]:
    """Numbers of the sets that may have at most ``max_groups`` groups, and the sample's groups of each."""
    complete = set(complete)
    over: set[frozenset[int]] = set()
    kept, sizes = [], []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i])):
        members = frozenset(sets[i])
        parts = [members - {j} for j in members if j in complete and len(members) > 1]
        if any(p in over for p in parts):
            over.add(members)
            continue
        n = sample.of(tuple(sets[i]))[1]
        if n > max_groups:
            over.add(members)
        else:
            kept.append(i)
            sizes.append(n)
    return kept, sizes


def _chunks(batches, slots: int):
    """Keys, their presence and the whole chunk, for about ``CHUNK_ROWS`` rows at a time."""
    held, n = [], 0

    def classes():
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(f"k{j}").combine_chunks() for j in range(slots)]
        return Classes([c.fill_null(0).to_numpy(zero_copy_only=False) for c in cols],
                       [c.is_valid().to_numpy(zero_copy_only=False) for c in cols]), table
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield classes()
            held, n = [], 0
    if n:
        yield classes()


class _Sums:
    """Groups of one set, merged from time to time."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, part: tuple[np.ndarray, ...]) -> None:
        self.parts.append(part)
        if len(self.parts) == 8:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) == 1:
            return self.parts[0]
        code, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        out = [code]
        for values in zip(*(p[1:] for p in self.parts)):
            values = np.concatenate(values)
            sums = np.zeros(len(code), values.dtype)
            np.add.at(sums, inverse, values)
            out.append(sums)
        return tuple(out)


def _partial_groups(sets: Sequence[tuple[int, tuple[int, ...]]], slots: int, measures: int) -> Callable:
    names = ["key_id", "code", "n", *[f"{p}{i}" for i in range(measures) for p in ("s", "c")]]

    def whole(g: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
        out = np.zeros(m, np.int64)
        np.add.at(out, g, weights)
        return out

    def run(batches):
        sums = {i: _Sums() for i, _ in sets}
        for classes, table in _chunks(batches, slots):
            n = table.column("n").to_numpy()
            numbers = [(table.column(f"s{i}").combine_chunks().fill_null(0.0).to_numpy(), table.column(f"c{i}").to_numpy())
                       for i in range(measures)]
            for i, members in sets:
                g, m = classes.of(members)
                if not m:
                    continue
                inside = g >= 0
                g = g[inside]
                first = np.zeros(m, np.int64)
                first[g[::-1]] = np.flatnonzero(inside)[::-1]
                part = [classes.codes(members, first), whole(g, n[inside], m)]
                for s, c in numbers:
                    part += [np.bincount(g, s[inside], m), whole(g, c[inside], m)]
                sums[i].add(tuple(part))
        for i, found in sums.items():
            if found.parts:
                cols = found.merged()
                for at in range(0, len(cols[0]), CHUNK_ROWS):
                    part = [c[at:at + CHUNK_ROWS] for c in cols]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part[0]), i, np.int32)), *map(pa.array, part)], names)
    return run


def _sample(fine: DataFrame, slots: int) -> Classes:
    """Classes of a bounded sample of the finest keys, chosen by hash."""
    names = [f"k{j}" for j in range(slots)]
    rows = fine.select(*names).orderBy(F.xxhash64(*names)).limit(SAMPLE_ROWS).collect()
    cols = [[r[j] for r in rows] for j in range(slots)]
    return Classes([np.array([v or 0 for v in c], np.int64) for c in cols], [np.array([v is not None for v in c], bool) for c in cols])


def group_tables(df: DataFrame, keys: Sequence[Sequence[str]], measures: Sequence[str] = (), *,
                 max_groups: int | None = None, complete: Iterable[str] = ()) -> DataFrame:
    """Groups of every key: (key_id, code, n, s0, c0, ..), one row a group.

    With ``max_groups``, keys that surely have more groups are left out; ``complete`` names the
    columns without NULLs, which let a part of a key rule out the key.
    """
    columns = list(dict.fromkeys(c for key in keys for c in key))
    slot = {c: j for j, c in enumerate(columns)}
    sets = [tuple(sorted(slot[c] for c in key)) for key in keys]
    fine = cut_lineage(finest(df, columns, measures))
    kept, sizes = list(range(len(sets))), [1] * len(sets)
    if len(sets) > FEW_SETS:
        sample = _sample(fine, len(columns))
        kept, sizes = surviving(sample, sets, max_groups if max_groups is not None else 1 << 62,
                                [slot[c] for c in complete if c in slot])
    schema = "key_id int, code long, n long" + "".join(f", s{i} double, c{i} long" for i in range(len(measures)))
    slices, held = [[]], 0
    for i, n in sorted(zip(kept, sizes), key=lambda x: sets[x[0]]):  # sets of one prefix together
        if slices[-1] and (held + n > HELD_GROUPS or len(slices[-1]) == SLICE_SETS):
            slices.append([])
            held = 0
        slices[-1].append((i, sets[i]))
        held += n
    parts = [fine.select(*[f"k{j}" for j in range(len(columns))], "n", *[
        f"{p}{i}" for i in range(len(measures)) for p in ("s", "c")]).mapInArrow(
        _partial_groups(own, len(columns), len(measures)), schema) for own in slices]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    sums = [F.sum(c).alias(c) for c in ["n", *[f"{p}{i}" for i in range(len(measures)) for p in ("s", "c")]]]
    return out.groupBy("key_id", "code").agg(*sums)


def _partial_pairs(pairs: Sequence[tuple[int, int]], slots: int) -> Callable:
    def run(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def table(items):
            cols = [np.concatenate(x) for x in zip(*[
                (np.full(len(v), i, np.int32), np.full(len(v), j, np.int32), v[:, 0], v[:, 1]) for (i, j), v in items])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "a", "b"])
        for classes, _ in _chunks(batches, slots):
            for i, j in pairs:
                g, m = classes.of((i, j))
                if not m:
                    continue
                inside = np.flatnonzero(g >= 0)
                first = np.zeros(m, np.int64)
                first[g[inside][::-1]] = inside[::-1]
                new = np.stack([classes.keys[i][first], classes.keys[j][first]], axis=1)
                old = found.get((i, j))
                new = new if old is None else np.unique(np.concatenate([old, new]), axis=0)
                size += len(new) - (0 if old is None else len(old))
                found[(i, j)] = new
            if size > HELD_GROUPS:
                for item in found.items():
                    yield table([item])
                found, size = {}, 0
        if found:
            yield table(list(found.items()))
    return run


def pair_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j (column numbers), a, b: distinct pairs of value hashes where both are present."""
    slots = len(columns)
    fine = cut_lineage(finest(df, columns))
    pairs = [(i, j) for i in range(slots) for j in range(i + 1, slots)]
    return fine.select(*[f"k{j}" for j in range(slots)]).mapInArrow(
        _partial_pairs(pairs, slots), "i int, j int, a long, b long").distinct()
