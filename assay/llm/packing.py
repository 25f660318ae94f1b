"""Packing by concatenate-and-cut.

Pass one turns each document into token ids plus an end id and writes them to shared files,
each with its position inside its input partition; the totals of the partitions, one number
each, are summed to give every partition its global base. Pass two knows each document's place
in the endless token stream from base + position alone and cuts it at every multiple of the
window, so each row is cut without looking at any other. A document that crosses a boundary
yields one record on each side. Only the last sequence needs padding.

Texts are encoded space by space: in byte-level BPE a space before a visible character always
starts a new unit, so equal words have equal ids and each is encoded once in a worker process.
Texts with other white space next to a space, or with a token that the vocabulary adds to its
pieces (such as an end mark), are encoded whole. Texts of the western code page alone go through a
second implementation of byte-pair merging, set up from the same vocabulary file if its merges
stand in the order of their ids; it gives the same ids some six times faster.

Results for unusual input: a null or empty text gives one piece with the end id alone; very
long texts are encoded in slices cut at such spaces; rows that repeat are packed again; no rows
give no pieces.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import cut_lineage, text_rows

WINDOW = 1024
END_ID = 0
#: Words whose ids a worker process remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 400_000
WORDS_AT_ONCE = 200
SLICE_CHARS = 1 << 20
#: Texts of these characters are merged by the faster implementation: their classes are the same in
#: every edition of Unicode.
FAST_PAGE = "cp1252"
#: Fixed pattern: the units of byte-level BPE.
UNITS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NAMES = ["part", "position", "doc_id", "n_tokens", "ids"]


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_table(vocabulary: str):
    """The vocabulary for the faster implementation; None if its rules are others."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        rules = json.load(file)
    model, units, letters = rules["model"], rules.get("pre_tokenizer") or {}, byte_letters()
    same = (model["type"] == "BPE" and not rules.get("normalizer") and units.get("type") == "ByteLevel"
            and units.get("use_regex", True) and not units.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix")))
    if not same:
        return None
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    added = {t["content"] for t in rules.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()
             if token not in added and all(c in letters for c in token)}
    if ids != sorted(ids) or len(set(ranks) & {bytes([b]) for b in range(256)}) < 256:
        return None
    return tiktoken.Encoding("merges", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            rules = json.load(file)
        self.vocabulary = vocabulary
        self.added = [t["content"] for t in rules.get("added_tokens", ())]
        self.width = 2 if len(rules["model"]["vocab"]) + len(self.added) <= 1 << 16 else 4
        del rules
        self.fast = merge_table(vocabulary)
        self.words: dict[str, bytes] = {}
        self.unsplit: set[str] = set()

    @cached_property
    def tokenizer(self):
        """Read when a text needs it: a worker process keeps it, beside the faster implementation, to its end."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    @cached_property
    def n_bytes(self) -> np.ndarray:
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            out[i] = len(token)  # byte-level tokens have one character for each byte
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it; many words are encoded as one text."""
        texts = [" " + " ".join(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int64) for e in found])
        ends = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
        if not np.array_equal(ends[cuts], wanted):
            raise ValueError("the vocabulary is not byte-level BPE with units that start at spaces")
        raw, at = ids.astype(f"<u{self.width}").tobytes(), [0, *((cuts + 1) * self.width).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def _slices(self, text: str):
        """Cut a very long text where a unit surely starts."""
        at = 0
        while len(text) - at > SLICE_CHARS:
            cut = text.rfind(" ", at + 1, at + SLICE_CHARS)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    @staticmethod
    def _western(text: str) -> bool:
        try:
            text.encode(FAST_PAGE)
        except UnicodeEncodeError:
            return False
        return True

    def _slice(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._raw([text])[0]
        if self.fast is not None and len(text) <= SLICE_CHARS and self._western(text):
            return np.array(self.fast.encode_ordinary(text), f"<u{self.width}").tobytes()
        parts = text.split(" ")
        rest = parts[1:]
        distinct = set(rest)
        new = list(distinct.difference(self.words))
        if new:
            if len(self.words) > REMEMBERED_WORDS:
                self.words, self.unsplit = {}, set()
                new = list(distinct)
            odd = [w for w in new if not w or w[0].isspace()]
            self.unsplit.update(odd)
            self.words.update(dict.fromkeys(odd, b""))
            plain = [w for w in new if w not in self.unsplit] if odd else new
            if plain:
                self.words.update(zip(plain, self._spaced(plain)))
        if not self.unsplit.isdisjoint(distinct):
            return self._raw([text])[0]
        return (self._raw(parts[:1])[0] if parts[0] else b"") + b"".join(map(self.words.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if len(text) <= SLICE_CHARS:
            return self._slice(text)
        return b"".join(map(self._slice, self._slices(text)))


def _process_encoder(vocabulary: str) -> Encoder:
    """One encoder for a worker process: this module travels with each task, ``sys`` stays."""
    kept = sys.__dict__.setdefault("_assay_encoders", {})
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def _tokenise(vocabulary: str, end_id: int):
    def run(batches):
        encode = _process_encoder(vocabulary)
        end = end_id.to_bytes(encode.width, "little")
        part, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                rows.append((part, position, doc_id, len(ids) // encode.width, ids))
                position += rows[-1][3]
                size += len(ids)
                if size > 8 << 20:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)
    return run


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """part, position, doc_id, n_tokens, ids of each row, on shared files."""
    return cut_lineage(text_rows(docs).mapInArrow(
        _tokenise(vocabulary, end_id), "part long, position long, doc_id long, n_tokens long, ids binary"))


def _cut(parts: np.ndarray, bases: np.ndarray, window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7

    def run(batches):
        for batch in batches:
            out, ids_out = [], []
            cols = [batch.column(c).to_pylist() for c in _NAMES]
            for part, position, doc_id, n, raw in zip(*cols):
                at = int(bases[np.searchsorted(parts, part)]) + position
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[start:start + length]
                    out.append((doc_id, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset))
                    if with_ids:
                        ids_out.append(piece)
                    start += length
            if out:
                arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` holds the token ids themselves."""
    tokens = tokenised(docs, vocabulary, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    parts = np.array([r.part for r in totals], np.int64)
    sizes = np.array([r.n for r in totals], np.int64)
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<long>" * with_ids)
    return tokens.mapInArrow(_cut(parts, np.cumsum(sizes) - sizes, window, with_ids), schema)
