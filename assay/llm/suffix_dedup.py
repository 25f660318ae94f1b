"""Removal of long repeated strings with suffix arrays built by two-stage sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too. Sorting
every suffix of a corpus in one place does not scale, so the suffixes are first dealt to where
their equals are. Every window of LENGTH bytes names one anchor: the ``GRAM``-byte string in
it with the smallest hash. Equal windows have equal anchors. Windows in a row with one anchor
form a run, kept as (anchor, hash of its bytes, place), about one row per 85 bytes; these rows
are dealt by anchor once. Only anchors that occur twice matter: a run whose bytes occur twice is
repeated as a whole, and if an anchor has runs with different bytes, those distinct strings are
gathered by anchor. Equal windows have half a window in common on one side of the anchor at
least, so strings that share neither side with another of their anchor are left out.

Whole texts move only where they are needed: a bitmap of the wanted texts' hashes, of ``MARKS``
bits at most, keeps the others where they are. It only saves work: a text that it lets through by
chance finds no partner in the join that follows.

A task gets whole anchors and sorts the suffixes of their strings in two stages: suffixes
smaller than their successors are sorted directly; all others follow from a scan of the
buckets in order, each placed suffix putting its predecessor next into its bucket. Neighbours
in this array that share LENGTH bytes are repeated windows. An anchor with more than
``ANCHOR_STRINGS`` distinct strings is too much for one task; its windows are hashed and
counted one by one instead, with sums on the map side.

An executor's memory is its heap and its Python workers, so those are kept small: a stage calls
Python once (a second call in it is a second worker for each task), texts become bytes one at a time,
lists of places come as arrays of integers, and sorting takes some 30 bytes for each byte.

Equal whole texts are one text everywhere, so copies do not multiply any of this.

Results for unusual input: null counts as empty; texts shorter than LENGTH stay; rows that
repeat are copies of one another; ids may be null; no rows give no rows. In ``clean`` a
character goes only if all its bytes go, so texts stay valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.common import cut_lineage, free_name

LENGTH = 200
GRAM = 32
#: Distinct strings of one anchor that are sorted in one task: at most some 4 MB.
ANCHOR_STRINGS = 10_000
#: Bytes sorted at once.
SORT_BYTES = 1 << 19
_BUFFER = 1 << 18
#: Bits of the map of wanted texts, in pieces of 2^15: at most 8 MB.
MARKS = 1 << 26
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` values in a row."""
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == span else np.minimum(h[:len(h) - (span - width)], h[span - width:])


class Anchors:
    """Finds the runs of a buffer of texts.

    A run's place is one number: 24 bits of the text's second hash, one that tells whether a
    window has its anchor twice (so that windows of one run can be equal), 31 bits of the offset
    in the text, 8 of the number of windows less one.
    """

    def __init__(self, length: int, gram: int, room: int):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_BASE, room), _powers(_INVERSE, room)

    def runs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """anchor, first window, number of windows, text, tie flag and context of each run, in order.

        ``starts`` and ``sizes`` are the places of the texts, all of at least ``length`` bytes. The
        context has 16 bits of what lies left of the anchor, and as many of what lies right. Equal
        windows without ties have one of them in common; a side of which no window has half is 0.
        """
        n, span = len(data), self.length - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        # the place within 256 bytes, wider than a window, tells equal hashes apart
        h &= ~np.uint64(255)
        place = np.arange(len(h), dtype=np.uint64) & np.uint64(255)
        low = _least(h | place, span)
        # counted down, it names another place if a window has its anchor twice
        tie = (_least(h | (np.uint64(255) - place), span) ^ low) & np.uint64(255) != np.uint64(255)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes - self.length + 1, -1)
        good = np.cumsum(edge)[:len(low)] > 0
        first = good.copy()
        first[1:] &= (low[1:] != low[:-1]) | ~good[:-1]
        at = np.flatnonzero(first)
        block = np.searchsorted(starts, at, "right") - 1
        stop = np.minimum(np.append(at[1:], n), starts[block] + sizes[block] - self.length + 1)
        ties = np.cumsum(np.concatenate(([False], tie)))
        half = (self.length - self.gram) // 2
        anchor = at + (((low[at] & np.uint64(255)).astype(np.int64) - at) & 255)
        left = self._side(sums, anchor - half, half + self.gram, anchor - at >= half)
        right = self._side(sums, anchor, self.length - half + 1, anchor - stop + 1 < half)
        return ((low[at] >> np.uint64(8)).astype(np.int64), at, stop - at, block, ties[stop] > ties[at],
                (left | right << np.uint32(16)).view(np.int32))

    def _side(self, sums: np.ndarray, at: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
        """16 bits of a hash of ``size`` bytes at each place, 1 at least; 0 where they are not there."""
        at = np.where(there, at, 0)
        h = (sums[np.where(there, at + size, 0)] - sums[at]) * self.down[at]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.where(there, h % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint32)


def _buffers(texts, length: int, room: int):
    """Groups of (row, offset, piece) that fit a buffer; long texts come in overlapping pieces."""
    held, size = [], 0
    for row, body in texts:
        at = 0
        while len(body) - at >= length:
            piece = body[at:at + room // 2]
            if held and size + len(piece) > room:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
            if at + len(piece) >= len(body):
                break
            at += len(piece) - length + 1
    if held:
        yield held


def _each(texts: pa.Array):
    """The UTF-8 bytes of one text after the other."""
    return (x.as_py() for x in texts.cast(pa.binary()))


def _run_rows(length: int, gram: int):
    def fresh(texts, t1, t2, seen):
        for row, (body, *name) in enumerate(zip(_each(texts), t1.tolist(), t2.tolist())):
            if len(body) >= length and (name := tuple(name)) not in seen:
                seen.add(name)
                yield row, body

    def run(batches):
        find = Anchors(length, gram, _BUFFER)
        digest = xxhash.xxh3_64_intdigest
        seen = set()  # copies in one task are read once
        for batch in batches:
            t1 = batch.column("t1").to_numpy()
            t2 = batch.column("t2").to_numpy()
            for held in _buffers(fresh(batch.column("text"), t1, t2, seen), length, _BUFFER):
                joined = b"".join(p for _, _, p in held)
                sizes = np.array([len(p) for _, _, p in held], np.int64)
                starts = np.cumsum(sizes) - sizes
                key, at, count, block, tied, context = find.runs(np.frombuffer(joined, np.uint8), starts, sizes)
                row = np.array([r for r, _, _ in held], np.int64)[block]
                offset = at - starts[block] + np.array([o for _, o, _ in held], np.int64)[block]
                signs = [digest(joined[i:j]) for i, j in zip(at.tolist(), (at + count + length - 1).tolist())]
                place = (t2[row].astype(np.uint64) << np.uint64(40)) | (
                    tied.astype(np.uint64) << np.uint64(39)) | (offset.astype(np.uint64) << np.uint64(8)) | (
                    count - 1).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key), pa.array(np.array(signs, np.uint64).view(np.int64)), pa.array(t1[row]),
                    pa.array(place.view(np.int64)), pa.array(context)], ["key", "sign", "t1", "place", "context"])
    return run


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and its two hashes: 64 bits in t1, 24 bits in t2."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("t1"), F.hash(text).bitwiseAND(F.lit(0xFFFFFF)).cast("long").alias("t2"))


def _mark(place: str) -> Column:
    return F.shiftrightunsigned(place, 40)


def _offset(place: str) -> Column:
    return F.shiftrightunsigned(place, 8).bitwiseAND(F.lit(0x7FFFFFFF))


def _windows(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(255)) + 1


def _tied(place: str) -> Column:
    return F.shiftrightunsigned(place, 39).bitwiseAND(F.lit(1).cast("long"))


# ---- sorting


def _places(n: int) -> type:
    """The type of places in ``n`` bytes."""
    return np.int32 if n < 1 << 31 else np.int64


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(text)
    nearest = np.arange(n, dtype=_places(n))
    nearest[:-1][text[1:] == text[:-1]] = n - 1
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return np.append(text[1:] > text[:-1], False)[nearest]


def directly_sorted(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` in the order of their first ``depth`` bytes.

    Eight bytes at a time, as integers, and only among those that are still equal; so memory is a
    few integers a suffix, however deep it goes.
    """
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(depth + 8, np.uint8))), 8)

    def words(places: np.ndarray) -> np.ndarray:
        return eight[places].view(">u8").ravel().astype(np.uint64)

    order = at.astype(_places(len(raw) + depth))
    key = words(order)
    sort = np.argsort(key, kind="stable")
    order, key = order[sort], key[sort]
    fresh = np.ones(len(order), bool)  # starts a group of equal suffixes
    fresh[1:] = key[1:] != key[:-1]
    del key, sort
    for d in range(8, depth, 8):
        equal = ~fresh
        equal[:-1] |= ~fresh[1:]
        open_ = np.flatnonzero(equal).astype(order.dtype)
        if not len(open_):
            break
        group, key = np.cumsum(fresh, dtype=order.dtype)[open_], words(order[open_] + order.dtype.type(d))
        sort = np.lexsort((key, group))
        order[open_], key = order[open_][sort], key[sort]
        fresh[open_[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    return order


def suffix_array(text: np.ndarray, raw: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least.

    ``text`` has symbols from 0; ``raw`` is the same as bytes that compare alike.
    """
    direct = directly_sorted(np.frombuffer(raw, np.uint8), np.flatnonzero(smaller_than_next(text)), depth)
    top = int(text.max()) + 1
    cuts = np.searchsorted(text[direct], np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]
    induced[text[-1]].append(np.array([len(text) - 1], direct.dtype))
    out = []
    for symbol in range(top):
        own = np.concatenate(induced[symbol]) if induced[symbol] else np.zeros(0, direct.dtype)
        induced[symbol].clear()
        bucket, fresh = [own], own
        while len(fresh):  # a run of one symbol induces within its own bucket
            before = fresh[fresh > 0] - 1
            fresh = before[text[before] == symbol]
            bucket.append(fresh)
        bucket.append(direct[cuts[symbol]:cuts[symbol + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > symbol]
        head = text[before]
        sort = np.argsort(head, kind="stable")
        head, before = head[sort], before[sort]
        edges = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else []
        for i, j in zip(edges, [*edges[1:], len(head)]):
            induced[head[i]].append(before[i:j])
    return np.concatenate(out)


def common_prefixes(raw: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Equal leading bytes of neighbours in ``order``, ``length`` at most."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, length)
    out = []
    for at in range(0, len(order) - 1, 8192):
        part = rows[order[at:at + 8193]]
        differ = part[1:] != part[:-1]
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1), length).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows occur elsewhere among the strings."""
    raw = b"\0".join(strings) + b"\0"
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(raw, np.uint8)
    order = suffix_array(data, raw, length)
    inside = np.zeros(len(raw), bool)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        inside[a:a + n - length + 1] = True
    order = order[inside[order]]
    equal = common_prefixes(data, order, length) >= length
    hit = np.zeros(len(raw), bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    return [hit[a:a + n - length + 1] for a, n in zip(starts.tolist(), sizes.tolist())]


def _ranges(flags: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def _sorted_strings(length: int, sort_bytes: int):
    """Rows (key, n, t1, place, body) sorted by key; the repeated windows of those with n = 1."""
    def find(rows):
        seen, n1, names = {}, [], []
        for n, t1, place, body in rows:
            if (t1, place) not in seen:
                seen[(t1, place)] = True
                n1.append(n)
                names.append((t1, place, body))
        out = []
        for n, (t1, place, _), flags in zip(n1, names, repeated_windows([b for _, _, b in names], length)):
            if n == 1:
                mark, offset = (place >> 40) & 0xFFFFFF, (place >> 8) & 0x7FFFFFFF
                out += [(t1, mark, offset + i, j - i) for i, j in _ranges(flags)]
        return _spans(out)

    def run(batches):
        rows, size, at = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "t1", "place", "body"))):
                if key != at and size > sort_bytes:
                    yield find(rows)
                    rows, size = [], 0
                at = key
                rows.append(row)
                size += len(row[3])
        if rows:
            yield find(rows)
    return run


def _spans(rows):
    names = ["t1", "t2", "offset", "windows"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)


def _asked(batches, length: int):
    """Lists of (key, n, t1, place, bytes) of the runs that each text is asked for, of some 4 MB."""
    for batch in batches:
        out, size = [], 0
        lists = batch.column("asked")
        ends, asked = lists.offsets.tolist(), lists.values
        for row, (body, t1) in enumerate(zip(_each(batch.column("text")), batch.column("t1").to_pylist())):
            own = asked[ends[row]:ends[row + 1]]
            for key, n, place in zip(*(own.field(c).to_pylist() for c in ("key", "n", "place"))):
                offset, windows = (place >> 8) & 0x7FFFFFFF, (place & 255) + 1
                out.append((key, n, t1, place, body[offset:offset + windows + length - 1]))
                size += windows + length
                if size > 4 << 20:
                    yield out
                    out, size = [], 0
        if out:
            yield out


def _strings(length: int):
    """The bytes of the runs that each text is asked for."""
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def run(batches):
        for rows in _asked(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["key", "n", "t1", "place", "body"])
    return run


def _window_hashes(length: int):
    """The hashes of the windows of the runs that each text is asked for."""
    def run(batches):
        for rows in _asked(batches, length):
            for _, n, t1, place, body in rows:
                count = len(body) - length + 1
                twice = [xxhash.xxh3_128_intdigest(body[i:i + length]) for i in range(count)]
                mark, offset = (place >> 40) & 0xFFFFFF, (place >> 8) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([x >> 64 for x in twice], np.uint64).view(np.int64)),
                    pa.array(np.array([x & (1 << 64) - 1 for x in twice], np.uint64).view(np.int64)),
                    pa.array([n] * count, pa.int64()), pa.array([t1] * count, pa.int64()),
                    pa.array([mark] * count, pa.int64()), pa.array(np.arange(offset, offset + count))],
                    ["h1", "h2", "n", "t1", "t2", "offset"])
    return run


def _gathered(runs: DataFrame) -> DataFrame:
    """The runs that may be repeated: how many have their bytes (n), and where.

    One run of each string to be sorted has its anchor in ``key``, and in ``m`` the number of such strings.
    """
    key, sign = Window.partitionBy("key"), Window.partitionBy("key", "sign")
    place = sign.orderBy("t1", "place")
    again = (F.lag("t1").over(place) == F.col("t1")) & (F.lag("place").over(place) == F.col("place"))
    left, right = F.col("context").bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned("context", 16)

    def shared(side: Column) -> Column:
        return (side != 0) & (F.count_if("sorted").over(Window.partitionBy("key", side)) > 1)

    return (runs.repartition("key")
            .withColumns({"c": F.count("*").over(key), "tied": F.max(_tied("place")).over(key)})
            .filter("c > 1 OR tied = 1").drop("c")
            .withColumns({"again": F.coalesce(again, F.lit(False)), "first": F.row_number().over(place) == 1})
            .filter("NOT again").drop("again")
            .withColumns({"n": F.count("*").over(sign), "m": F.count_if("first").over(key)})
            .filter("n > 1 OR m > 1 OR tied = 1")
            .withColumn("sorted", F.expr("first AND (m > 1 OR tied = 1)"))
            .withColumn("sorted", F.col("sorted") & ((F.col("tied") == 1) | shared(left) | shared(right)))
            .withColumn("m", F.count_if("sorted").over(key))
            .filter("n > 1 OR sorted")
            .select(F.when(F.col("sorted"), F.col("key")).alias("key"), "n", "m", "t1", "place"))


def wanted_only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``identified`` rows nearly only those whose t1 is in ``wanted``, found without a shuffle of them."""
    piece = F.col("t1").bitwiseAND(F.lit((MARKS >> 15) - 1))
    bit = F.shiftrightunsigned("t1", 40).bitwiseAND(F.lit(0x7FFF))
    marks = wanted.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = "cast(conv(hex(substring(bits, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    return (rows.withColumns({"piece": piece, "bit": bit}).join(F.broadcast(marks), "piece")
            .filter(f"shiftright({byte}, cast(bit % 8 AS int)) % 2 = 1").drop("piece", "bits", "bit"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, anchor_strings: int = ANCHOR_STRINGS,
                   sort_bytes: int = SORT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Spans (t1, t2, offset, windows) of repeated windows of each distinct text, and the
    distinct texts themselves (t1, t2, rep, copies)."""
    rows = identified(docs)
    texts = cut_lineage(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    found = cut_lineage(_gathered(rows.select("text", "t1", "t2").mapInArrow(
        _run_rows(length, gram), "key long, sign long, t1 long, place long, context int")))
    spans = found.filter("n > 1").select(
        "t1", _mark("place").alias("t2"), _offset("place").alias("offset"), _windows("place").alias("windows"))
    mixed = found.filter("key IS NOT NULL").withColumn("t2", _mark("place"))

    def texts_asked(wanted: DataFrame) -> DataFrame:
        asked = cut_lineage(
            wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "n", "place")).alias("asked"))
            .join(texts.drop("copies"), ["t1", "t2"]))
        return (wanted_only(rows, asked).alias("r").join(asked.alias("a"), (F.col("r.t1") == F.col("a.t1")) & (
            F.col("r.t2") == F.col("a.t2")) & F.col("r.doc_id").eqNullSafe(F.col("a.rep")))
            .select("r.text", "r.t1", "a.asked"))

    spans = spans.union(texts_asked(mixed.filter(F.col("m") <= anchor_strings))
                        .mapInArrow(_strings(length), "key long, n long, t1 long, place long, body binary")
                        .repartition("key").sortWithinPartitions("key")
                        .mapInArrow(_sorted_strings(length, sort_bytes), "t1 long, t2 long, offset long, windows long"))
    crowded = mixed.filter(F.col("m") > anchor_strings)
    if crowded.take(1):
        hashes = cut_lineage(texts_asked(crowded).mapInArrow(
            _window_hashes(length), "h1 long, h2 long, n long, t1 long, t2 long, offset long").distinct())
        again = hashes.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
        spans = spans.union(hashes.filter("n = 1").join(again, ["h1", "h2"], "left_semi")
                            .select("t1", "t2", "offset", F.lit(1).cast("long").alias("windows")))
    return spans, texts


def _listed(spans: DataFrame) -> DataFrame:
    """t1, t2 and the text's spans, each as one integer: the offset, and 16 bits of the number of windows."""
    span = F.shiftleft("offset", 16).bitwiseOR(F.col("windows"))
    return spans.groupBy("t1", "t2").agg(F.collect_list(span).alias("spans"))


def merged(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of listed spans."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    start = spans >> 16
    end = np.maximum.accumulate(start + (spans & 0xFFFF) + (length - 1))
    first = np.append(True, start[1:] > end[:-1])
    return list(zip(start[first].tolist(), end[np.append(first[1:], True)].tolist()))


def without(body: bytes, ranges: list[tuple[int, int]], whole_characters: bool = False) -> bytes:
    """``body`` without the ranges; with whole characters, half-covered ones stay."""
    kept, at = [], 0
    for a, b in ranges:
        if whole_characters:
            while a < b and body[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                b -= 1
        kept.append(body[at:a])
        at = b
    return b"".join(kept) + body[at:]


def _removed(length: int):
    def run(batches):
        for batch in batches:
            out = []
            lists = batch.column("spans")
            ends, spans = lists.offsets.tolist(), lists.values.to_numpy()
            names = zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())
            for row, (body, (t1, t2)) in enumerate(zip(_each(batch.column("text")), names)):
                ranges = merged(spans[ends[row]:ends[row + 1]], length)
                out.append((t1, t2, sum(b - a for a, b in ranges), len(ranges),
                            hashlib.sha256(without(body, ranges)).hexdigest()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["t1", "t2", "n_removed", "n_spans", "kept_sha256"])
    return run


def removals(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans, texts = repeated_spans(docs, length, **options)
    single = texts.filter("copies = 1").select("t1", "t2")
    lists = cut_lineage(_listed(spans).join(single, ["t1", "t2"], "left_semi"))
    done = wanted_only(identified(docs), lists).join(lists, ["t1", "t2"]).mapInArrow(
        _removed(length), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string")
    rows = identified(docs).select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"),
                                   F.sha2("text", 256).alias("sha"))
    out = (rows.join(texts.drop("rep"), ["t1", "t2"]).join(done, ["t1", "t2"], "left"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def clean(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """All documents without their repeated strings; all columns as they are.

    ``n_chars``, if there, follows the new text.
    """
    spans, texts = repeated_spans(docs, length, **options)
    copied = texts.filter("copies > 1").select("t1", "t2", F.lit(True).alias("copied"))
    lists = _listed(spans)
    t1, t2, own, all_gone = (free_name(f"__{n}", docs) for n in ("t1", "t2", "spans", "copied"))
    cuts = lists.join(copied, ["t1", "t2"], "full").select(
        F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(own), F.col("copied").alias(all_gone))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else t if s is None else without(t.encode(), merged(s, length), True).decode()
            for t, s in zip(text, spans)])

    text = F.coalesce("text", F.lit(""))
    found = docs.withColumns({t1: F.xxhash64(text), t2: F.hash(text).bitwiseAND(F.lit(0xFFFFFF)).cast("long")}).join(
        cuts, [t1, t2], "left")
    gone = F.col(all_gone) & (F.octet_length(text) >= length)
    out = found.withColumn("text", F.when(gone, F.lit("")).otherwise(cut("text", own)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
