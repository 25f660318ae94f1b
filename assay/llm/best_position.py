"""Ranked lexical search by the Best Position Algorithm over impact lists.

Pass one turns each document into its number of terms and its counts of the items' terms, on
shared files; sums over that table give the corpus figures and document frequencies. Pass two
streams the table: a task cuts what it reads into shards of at most ``SHARD_POSTINGS`` postings,
so an index never crosses the network and one task holds one shard. In a shard each term has an
impact list, ordered by what the term adds to a document's score. For an item the next unseen
positions of its lists are accessed directly; each document found there is looked up in all of the
item's lists, which marks its positions as seen. The best position of a list is the end of its
seen run from the top; the impacts at the best positions bound every document not yet seen, and
the search of a shard ends when that sum is strictly below the kth score. The kth score of the
shards before it is a floor for the next one, as the ranks of a task hold for all its shards.

Items are read in blocks of at most ``BLOCK_TERMS`` different terms (at least one item); only one
block is in the driver's memory, and each block is a run over the documents. Ranks of the tasks,
k rows for an item at most, are merged by a window.

Results for unusual input: null and empty texts have no terms, so they are in no result and no
count; an item without terms has no rows; items that repeat are ranked once a row; documents that
repeat are ranked once a row; a document without doc_id comes after others of its score; no
documents or no items give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assay.llm.common import as_bytes, cut_lineage, text_rows, with_rows

K = 10
BLOCK_TERMS = 200_000
SHARD_POSTINGS = 1 << 20
#: Positions of a list that are accessed at once; doubled from step to step.
FIRST_STEP, LAST_STEP = 16, 2048
#: Bytes of a text that are split into terms at once.
SLICE_BYTES = 1 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    body, at = body.translate(_TABLE), 0
    while len(body) - at > SLICE_BYTES:
        cut = body.rfind(b" ", at, at + SLICE_BYTES)
        cut = body.find(b" ", at + SLICE_BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield body[at:cut].split()
        at = cut + 1
    yield body[at:].split()


def _counted(vocabulary: dict[bytes, int]):
    """Number of terms of each text, and how often it has each term of the vocabulary."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, cuts, terms, times = [], [0], [], []
        for body in as_bytes(batch.column("text")):
            n, counts = 0, Counter()
            for words in terms_of(body):
                n += len(words)
                counts.update(map(vocabulary.get, words))
            counts.pop(None, None)
            sizes.append(n)
            terms += counts.keys()
            times += counts.values()
            cuts.append(len(terms))
        cuts = pa.array(cuts, pa.int32())
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(terms, pa.int32())),
            pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])
    return with_rows(rows)


def term_weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


class Shard:
    """Impact lists of some documents: by impact for the order, by document for direct access."""

    def __init__(self, held: list[pa.RecordBatch], weights: np.ndarray, n_documents: int, n_terms: int):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        lists = table.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy()
        times = table.column("times").combine_chunks().flatten().to_numpy()
        # Python integers: 90 * n * N may pass 64 bits
        m = np.array([10 + 90 * n * n_documents // n_terms for n in table.column("n").to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        impact = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        use = impact > 0
        term, doc, impact = term[use], doc[use], impact[use]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))
        by_doc = np.lexsort((self.doc, term[order]))
        self.sorted_doc = self.doc[by_doc]
        self.position = by_doc - self.start[term[order][by_doc]]

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the best k, given that k others reach ``floor``."""
        spans = [(a, b) for a, b in zip(self.start[terms], self.start[terms + 1]) if a < b]
        seen = [np.zeros(b - a + 1, bool) for a, b in spans]  # a last entry stays unseen and ends the run
        best = [0] * len(spans)  # entries in the seen run
        met = np.zeros(len(self.doc_id), bool)
        docs, scores, step = [], [], FIRST_STEP
        while True:
            found = []
            for (a, b), s, at in zip(spans, seen, best):
                new = self.doc[a + at:min(a + at + step, b)]
                found.append(new[~s[at:at + len(new)]])
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            found = found[~met[found]]
            if not len(found):
                break
            met[found] = True
            score = np.zeros(len(found), np.int64)
            bound = 0
            for i, (a, b) in enumerate(spans):
                if best[i] == b - a:
                    continue  # every document of this list has been met
                own = self.sorted_doc[a:b]
                at = np.minimum(np.searchsorted(own, found), b - a - 1)
                hit = own[at] == found
                place = self.position[a + at[hit]]
                score[hit] += self.impact[a + place]
                seen[i][place] = True
                best[i] += int(np.argmin(seen[i][best[i]:]))
                bound += int(self.impact[a + best[i] - 1]) if 0 < best[i] < b - a else 0
            docs.append(found)
            scores.append(score)
            kept = np.concatenate(scores)
            if len(kept) >= k:
                floor = max(floor, int(np.partition(kept, len(kept) - k)[len(kept) - k]))
            if bound < floor:
                break
            step = min(2 * step, LAST_STEP)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = (scores >= max(floor, 1))
        return docs[good], scores[good]


def _ranked(items: list[tuple[int, int | None, list[int]]], weights: np.ndarray, n_documents: int, n_terms: int, k: int,
            shard_postings: int):
    """The best k documents of each item among the rows that a task reads."""
    queries = [(number, item_id, np.array(terms, np.int64)) for number, item_id, terms in items]

    def run(batches):
        best = {}

        def close(held):
            shard = Shard(held, weights, n_documents, n_terms)
            for number, _, terms in queries:
                old = best.get(number)
                floor = int(old[0][k - 1]) if old is not None and len(old[0]) == k else 0
                docs, scores = shard.search(terms, k, floor)
                if not len(docs):
                    continue
                ids, known = shard.doc_id[docs], shard.known[docs]
                if old is not None:
                    scores, ids, known = (np.concatenate(x) for x in zip(old, (scores, ids, known)))
                order = np.lexsort((ids, ~known, -scores))[:k]
                best[number] = scores[order], ids[order], known[order]

        held, size = [], 0
        for batch in batches:
            # A batch may hold more than a shard: cut it by postings.
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + shard_postings - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - done)
                at = to
                if size >= shard_postings or at < len(sizes):
                    close(held)
                    held, size = [], 0
        if held:
            close(held)
        rows = [(number, item_id, int(i) if here else None, int(s)) for number, item_id, _ in queries if number in best
                for s, i, here in zip(*best[number])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             ["number", "item_id", "doc_id", "score"])
    return run


def blocks(items: DataFrame, key: str, most: int) -> Iterator[tuple[list[tuple[int, int | None, list[int]]], dict[bytes, int]]]:
    """The items with their terms as numbers, and the numbers, block by block."""
    held, vocabulary = [], {}
    for number, row in enumerate(text_rows(items, key).toLocalIterator()):
        own = {w for words in terms_of(row["text"].encode()) for w in words}
        if held and len(vocabulary.keys() | own) > most:
            yield held, vocabulary
            held, vocabulary = [], {}
        held.append((number, row[key], [vocabulary.setdefault(w, len(vocabulary)) for w in sorted(own)]))
    if held:
        yield held, vocabulary


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "item_id", block_terms: int = BLOCK_TERMS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``key``, rank, doc_id, score: the best ``k`` documents of each item."""
    found = None
    for block, vocabulary in blocks(items, key, block_terms):
        counted = cut_lineage(text_rows(docs).mapInArrow(
            _counted(vocabulary), "doc_id long, n long, terms array<int>, times array<long>").filter("n > 0"))
        n_documents, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, frequency in frequencies:
            weights[term] = term_weight(n_documents, frequency)
        rows = counted.mapInArrow(_ranked(block, weights, n_documents, n_terms, k, shard_postings),
                                  "number long, item_id long, doc_id long, score long")
        found = rows if found is None else found.union(rows)
    if found is None:
        found = items.sparkSession.createDataFrame([], "number long, item_id long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("item_id").alias(key), "rank", "doc_id", "score")
