"""SentencePiece encoding as a best path, by a max-plus parallel scan, and decoding.

The pieces and scores of a vocabulary file span a lattice over each text; its best path is the
encoding: the segmentation with the largest sum of scores. Among equal sums the last piece is
as long as possible, at every position. Characters without a piece cost ten less than the
worst piece and become byte pieces. Spaces become U+2581, one is put in front, as the files'
own normalisation says. Scores are kept as integers, so sums do not depend on their order.

No piece crosses from a visible character into a space, so texts are encoded word by word and
each distinct word once. Giant texts are cut into chunks first. What a chunk needs to know of
those before it are the best scores at its last ``reach`` positions; a chunk therefore is a
matrix over the (max, +) numbers from such boundary states to the next, and matrices combine
associatively, in blocks and then over blocks. With its incoming state every chunk finds its
best predecessors alone, states how a path that enters it from the right leaves it to the left,
and, once these maps are chained, traces its own part of the path.

Results for unusual input: null and empty texts have no pieces; U+2581 in a text decodes as a
space; rows that repeat are encoded alike; ids may be null; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assay.llm.common import cut_lineage, text_rows

SPACE = "▁"
#: Longer texts, in characters, are cut into chunks of ``CHUNK`` characters.
GIANT = 65_536
CHUNK = 16_384
#: Chunks whose matrices are combined in one task.
BLOCK = 64
REMEMBERED_WORDS = 600_000
_NONE = -(1 << 62)
DIGESTS = "doc_id long, score double, n_pieces long, ids_crc32 long, decoded_sha256 string"
_CUT = re.compile(f"[^{SPACE}]{SPACE}")


class Lattice:
    """Pieces, scores and best paths of one vocabulary file."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.scale = 1 if all(float(s).is_integer() for s in scores.values()) else 1 << 16
        self.score = {p: round(s * self.scale) for p, s in scores.items()}
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.unknown = min(self.score.values()) - 10 * self.scale
        self.unknown_id = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.reach = max(map(len, self.score))
        #: Score of each piece; None for a beginning of a piece that is not one itself.
        self.table: dict[str, int | None] = {p[:k]: None for p in self.score for k in range(1, len(p))} | self.score
        self.word = self._units()
        self.piece = [b""] * n
        for i in plain:
            self.piece[i] = sp.id_to_piece(i).encode()
        for byte, i in self.bytes.items():
            self.piece[i] = bytes([byte])
        self.joined = np.frombuffer(b"".join(self.piece), np.uint8)
        self.sizes = np.array([len(p) for p in self.piece], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words: dict[str, tuple[bytes, int]] = {}

    def _units(self) -> re.Pattern:
        """Pattern of the units that no piece crosses out of.

        Letters and other characters are units of their own if no piece mixes them; letters
        that some piece does mix count as others. A line end without a piece stands alone.
        """
        line = "" if any("\n" in p for p in self.score) else "\n"
        mixing: set[str] = set()
        while True:
            letter = re.compile(rf"[^\W\d_{re.escape(''.join(sorted(mixing)))}]")
            found = {a if letter.match(a) else b for p in self.score for a, b in zip(p, p[1:])
                     if SPACE not in (a, b) and bool(letter.match(a)) != bool(letter.match(b))}
            if not found:
                break
            mixing |= found
        other = f"(?:(?!{letter.pattern})[^{SPACE}{line}])"
        return re.compile(f"{SPACE}*{letter.pattern}+|{SPACE}*{other}+|{SPACE}+" + (f"|{line}" if line else ""))

    @staticmethod
    def normalised(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def pieces_from(self, text: str, start: int):
        """(length, score) of the lattice's edges that start at a position, short ones first."""
        score = self.score.get(text[start])
        yield 1, self.unknown if score is None else score
        for size in range(2, min(self.reach, len(text) - start) + 1):
            score = self.table.get(text[start:start + size], 0.5)
            if score == 0.5:  # neither a piece nor a beginning of one
                return
            if score is not None:
                yield size, score

    def forward(self, text: str, first: int, best: list[int]) -> tuple[list[int], list[int]]:
        """Best scores and last piece lengths for positions after ``first``.

        ``best`` has the scores of positions 0 .. first, _NONE where there is none.
        """
        n = len(text)
        best = best + [_NONE] * (n - first)
        back = [0] * (n + 1)
        find, unknown, reach = self.table.get, self.unknown, self.reach
        for start in range(max(0, first - reach + 1), n):
            here = best[start]
            if here == _NONE:
                continue
            end = start + 1
            score = find(text[start], 0.5)
            if end > first:
                total = here + (unknown if score is None or score == 0.5 else score)
                if total > best[end]:
                    best[end], back[end] = total, 1
            if score == 0.5:
                continue
            for end in range(start + 2, min(start + reach, n) + 1):
                score = find(text[start:end], 0.5)
                if score is not None:
                    if score == 0.5:
                        break
                    if end > first and here + score > best[end]:
                        best[end], back[end] = here + score, end - start
        return best, back

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes.get(b, self.unknown_id) for b in p.encode()]
        return out

    def _word(self, word: str) -> tuple[bytes, int]:
        best, back = self.forward(word, 0, [0])
        pieces, at = [], len(word)
        while at:
            pieces.append(word[at - back[at]:at])
            at -= back[at]
        return array("I", self.ids_of(pieces[::-1])).tobytes(), best[-1]

    def encode(self, text: str) -> tuple[bytes, int]:
        """Ids (32 bits each) and total score of a whole text."""
        words = self.word.findall(self.normalised(text))
        new = set(words).difference(self.words)
        if len(self.words) > REMEMBERED_WORDS:
            self.words, new = {}, set(words)
        for w in new:
            self.words[w] = self._word(w)
        found = list(map(self.words.__getitem__, words))
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        parts = []
        for at in range(0, len(found), 1 << 18):
            own = found[at:at + (1 << 18)]
            sizes = self.sizes[own]
            shift = self.starts[own] - (np.cumsum(sizes) - sizes)
            parts.append(self.joined[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(parts).decode().replace(SPACE, " ")[1:]

    # ---- chunks; a body has up to ``reach`` characters in front of the chunk, ``first`` of them

    def matrix(self, body: str, first: int) -> np.ndarray:
        """Entry [i, j]: best score from i positions before the chunk to j positions before its end."""
        r, n = self.reach, len(body)
        rows = np.full((n + 1, r), _NONE, np.int64)
        for i in range(min(r, first + 1)):
            rows[first - i, i] = 0
        cut = _CUT.search(body, max(0, first - 1))
        stop = n if cut is None else cut.start() + 1
        for start in range(max(0, first - r + 1), stop):
            here = rows[start]
            live = here != _NONE
            if live.any():
                for size, score in self.pieces_from(body, start):
                    end = start + size
                    if end > first:
                        rows[end] = np.maximum(rows[end], np.where(live, here + score, _NONE))
        if stop < n:  # no piece crosses this place, so all that follows is one path for every state
            after, _ = self.forward(body[stop:], 0, [0])
            base = rows[stop]
            for p in range(max(stop + 1, n - r + 1), n + 1):
                rows[p] = np.where(base != _NONE, base + after[p - stop], _NONE)
        out = np.full((r, r), _NONE, np.int64)
        for j in range(min(r, n + 1)):
            out[:, j] = rows[n - j]
        return out

    def leaves(self, body: str, first: int, state: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """For each place before the chunk's end: how far before the chunk its path leaves."""
        best = [_NONE] * (first + 1)
        for i in range(min(self.reach, first + 1)):
            best[first - i] = int(state[i])
        _, back = self.forward(body, first, best)
        out = np.zeros(self.reach, np.int64)
        for j in range(self.reach):
            at = len(body) - j
            while at > first:
                at -= back[at]
            out[j] = max(0, first - at)
        return out, back

    def trace(self, body: str, first: int, state: np.ndarray, entry: int) -> bytes:
        """Ids of the pieces that end in the chunk, on the path that enters at ``entry``."""
        _, back = self.leaves(body, first, state)
        pieces, at = [], len(body) - entry
        while at > first:
            pieces.append(body[at - back[at]:at])
            at -= back[at]
        return np.array(self.ids_of(pieces[::-1]), "<u4").tobytes()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices."""
    out = np.full((a.shape[0], b.shape[1]), _NONE, np.int64)
    for k in range(a.shape[1]):
        both = (a[:, k, None] != _NONE) & (b[None, k, :] != _NONE)
        np.maximum(out, np.where(both, a[:, k, None] + np.where(both, b[None, k, :], 0), _NONE), out=out)
    return out


def _grid(raw: bytes, reach: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, reach)


def _small(vocabulary: str, digests: bool):
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids, score = lattice.encode(text)
                if digests:
                    out.append((doc_id, score / lattice.scale, *_digest(lattice, ids)))
                    continue
                out.append((doc_id, ids, score / lattice.scale))
                size += len(ids)
                if size > 8 << 20:
                    yield _ids_batch(out)
                    out, size = [], 0
            if out:
                yield _digest_batch(out) if digests else _ids_batch(out)
    return run


def _digest(lattice: Lattice, ids: bytes) -> tuple[int, int, str]:
    """Number of pieces, CRC-32 of the ids and SHA-256 of the text that they decode to."""
    return len(ids) // 4, zlib.crc32(ids), hashlib.sha256(lattice.decode(ids).encode()).hexdigest()


def _digest_batch(rows):
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["doc_id", "score", "n_pieces", "ids_crc32", "decoded_sha256"])


def _ids_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
        zip(*rows), (pa.int64(), pa.binary(), pa.float64()))], ["doc_id", "ids", "score"])


def _chunks(vocabulary: str, chunk: int):
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text, name = lattice.normalised(text), uuid.uuid4().hex
                for i, at in enumerate(range(0, len(text), chunk)):
                    first = min(at, lattice.reach)
                    body = text[at - first:at + chunk]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name]), pa.array([doc_id], pa.int64()), pa.array([i], pa.int64()), pa.array([first], pa.int64()),
                        pa.array([body], pa.string()), pa.array([lattice.matrix(body, first).tobytes()], pa.binary())],
                        ["text_key", "doc_id", "chunk", "first", "body", "matrix"])
    return run


def _giants(docs: DataFrame, vocabulary: str, chunk: int, block: int, reach: int) -> DataFrame:
    """doc_id, ids, score of texts cut into chunks."""
    chunks = cut_lineage(docs.mapInArrow(
        _chunks(vocabulary, chunk),
        "text_key string, doc_id long, chunk long, first long, body string, matrix binary"))
    blocked = chunks.withColumn("block", F.expr(f"chunk div {block}"))

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in rows.sort_values("chunk")["matrix"]:
            total = _grid(raw, reach) if total is None else combine(total, _grid(raw, reach))
        return pd.DataFrame({"text_key": rows["text_key"].iloc[:1], "block": rows["block"].iloc[:1],
                             "matrix": [total.astype("<i8").tobytes()]})

    def scan(name: str, start: bool):
        """States before each matrix of a sequence; the first is that of a text's start or given."""
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(name)
            if start:
                state = np.full((1, reach), _NONE, np.int64)
                state[0, 0] = 0
            else:
                state = _grid(rows["state"].iloc[0], reach)
            states = []
            for raw in rows["matrix"]:
                states.append(state.astype("<i8").tobytes())
                state = combine(state, _grid(raw, reach))
            return pd.DataFrame({"text_key": rows["text_key"], name: rows[name], "state": states,
                                 "score": float(state[0, 0])})
        return run

    whole = blocked.select("text_key", "block", "chunk", "matrix").groupBy("text_key", "block").applyInPandas(
        product, "text_key string, block long, matrix binary")
    starts = cut_lineage(whole.groupBy("text_key").applyInPandas(
        scan("block", True), "text_key string, block long, state binary, score double"))
    states = blocked.select("text_key", "block", "chunk", "matrix").join(
        starts.drop("score"), ["text_key", "block"]).groupBy("text_key", "block").applyInPandas(
        scan("chunk", False), "text_key string, chunk long, state binary, score double").drop("score")
    placed = cut_lineage(chunks.drop("matrix").join(states, ["text_key", "chunk"]))

    def leave(batches):
        lattice = Lattice(vocabulary)
        for rows in batches:
            yield pd.DataFrame({"text_key": rows["text_key"], "chunk": rows["chunk"], "leaves": [
                lattice.leaves(b, f, _grid(s, reach)[0])[0].astype("<i8").tobytes()
                for b, f, s in zip(rows["body"], rows["first"], rows["state"])]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows, entry, entries = rows.sort_values("chunk", ascending=False), 0, []
        for raw in rows["leaves"]:
            entries.append(entry)
            entry = int(_grid(raw, reach)[0, entry])
        return pd.DataFrame({"text_key": rows["text_key"], "chunk": rows["chunk"], "entry": entries})

    entries = placed.mapInPandas(leave, "text_key string, chunk long, leaves binary").groupBy("text_key").applyInPandas(
        chain, "text_key string, chunk long, entry long")

    def trace(batches):
        lattice = Lattice(vocabulary)
        for rows in batches:
            yield pd.DataFrame({"text_key": rows["text_key"], "doc_id": rows["doc_id"], "chunk": rows["chunk"], "ids": [
                lattice.trace(b, f, _grid(s, reach)[0], e)
                for b, f, s, e in zip(rows["body"], rows["first"], rows["state"], rows["entry"])]})

    parts = placed.join(entries, ["text_key", "chunk"]).select(
        "text_key", "doc_id", "chunk", "first", "body", "state", "entry").mapInPandas(
        trace, "text_key string, doc_id long, chunk long, ids binary")
    joined = parts.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).select(
        "text_key", "doc_id", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))")
        .alias("ids"))
    scores = starts.groupBy("text_key").agg(F.max_by("score", "block").alias("score"))
    return joined.join(scores, "text_key").select("doc_id", "ids", "score")


def encode(docs: DataFrame, vocabulary: str, giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK,
           digests: bool = False) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits each) and score of each row.

    With ``digests`` the ids are decoded again where they were made, and their number, CRC-32
    and the SHA-256 of the decoded text take their place.
    """
    lattice = Lattice(vocabulary)
    if chunk < lattice.reach:
        raise ValueError("a chunk must be at least as long as the longest piece")
    rows = text_rows(docs)
    small = rows.filter(F.length("text") <= giant).mapInArrow(
        _small(vocabulary, digests), DIGESTS if digests else "doc_id long, ids binary, score double")
    large = _giants(rows.filter(F.length("text") > giant), vocabulary, chunk, block, lattice.reach).select(
        "doc_id", "ids", F.expr(f"score / {lattice.scale}D").alias("score"))
    return small.union(digest(large, vocabulary) if digests else large)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of each row of ids."""
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                [lattice.decode(i) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """DIGESTS of encoded rows."""
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            if batch.num_rows:
                yield _digest_batch([(d, s, *_digest(lattice, i)) for d, i, s in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "ids", "score")))])
    return encoded.mapInArrow(run, DIGESTS)
