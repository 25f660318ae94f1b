import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import packing, sentencepiece_scan, warc
from assay.llm.queries import tokenizer_file
from tests.llm.samples import ODD, no_docs, odd_docs, table

BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")

# ---- packing


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


SPACES = ["a  b", "a \nb", "\n \n b", "  x", " x", "x ", "x  ", "", "\t a", "a  b", "a <|endoftext|> b", "x<|endoftext|>", " <|endoftext|><|endoftext|>  y", "it's we've", "　 é"]


@pytest.mark.parametrize("slice_chars", [1 << 20, 50])
def test_words_and_slices_encode_as_whole_texts(monkeypatch, slice_chars):
    monkeypatch.setattr(packing, "SLICE_CHARS", slice_chars)
    texts = SPACES + [t for _, t in ODD if t and len(t) < 10_000]
    encode = packing.Encoder(BPE)
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == plain_ids(texts)


def check_pieces(rows, want):
    """Gapless sequences of at most 1024, and every document's ids exactly once."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in sequences.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        total = parts[-1][0] + parts[-1][1]
        assert total == 1024 or i == max(sequences) and total < 1024
    assert sorted(sequences) == list(range(len(sequences)))
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    for (doc_id, start, length, crc, n), times in got.items():
        found = [ids for d, ids in want if d == doc_id and len(ids) == n]
        assert any(zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc for ids in found)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)


def test_pieces_cover_odd_rows(spark):
    rows = packing.pack(odd_docs(spark).repartition(3), BPE, with_ids=False).collect()
    ids = plain_ids([t or "" for _, t in ODD])
    check_pieces(rows, [(d, i + [0]) for (d, _), i in zip(ODD, ids)])
    assert packing.pack(no_docs(spark), BPE).count() == 0


def test_pieces_carry_their_ids(spark):
    rows = packing.pack(table(spark, "documents"), BPE, window=256).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


# ---- WARC


def test_round_trip_of_odd_pages(spark):
    big = "<p>" + "x" * 2_000_000
    rows = [(3, "http://a/ü?q=1 2", "y" * 100), (1, None, "y" * 100), (2, "u\r\nX: y", "small"), (5, "u", "small"), (4, "u", None),
            (None, "u", "z" * 200), (6, "u", "z" * 200), (7, "u", big), (7, "u", big), (8, "u", "é" * 50), (9, "u", "é" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    got = Counter()
    for r in warc.round_trip(df).collect():
        assert r.error is None
        size = len(r.payload) if r.payload is not None else r.declared_bytes
        got[(r.page_id, r.record_type, r.refers_to, size, r.declared_digest)] += 1
    want = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "").encode() == body and p is not None)
        again = len(body) >= 100 and page_id != first
        want[(page_id, "revisit" if again else "response", first if again else None, len(body), hashlib.sha256(body).hexdigest())] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def records(n, squeeze):
    raw = [warc.record(i, f"http://h/{i}", (f"payload {i} " * 30).encode(), None) for i in range(n)]
    return [warc.member(r) for r in raw] if squeeze else raw


def salvaged(data):
    found = list(warc.salvage(data))
    ids = [warc._number(h["warc-record-id"]) for _, _, e, rs in found if e is None for h, _ in rs]
    return ids, [(o, n) for o, n, e, _ in found if e is not None]


@pytest.mark.parametrize("squeeze", [True, False])
def test_salvage_after_damage(squeeze):
    parts = records(6, squeeze)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    data = bytearray(b"".join(parts))
    assert salvaged(bytes(data)) == (list(range(6)), [])
    data[at[2] + len(parts[2]) // 2] ^= 0xFF
    ids, gaps = salvaged(bytes(data))
    assert ids == [0, 1, 3, 4, 5] and gaps == [(at[2], len(parts[2]))]
    cut = bytes(data[:at[4]]) + b"garbage WARC/1 \x1f\x8b\x08 no" + bytes(data[at[4]:-10])
    ids, gaps = salvaged(cut)
    assert ids == [0, 1, 3, 4] and len(gaps) == 3
    assert salvaged(b"") == ([], []) and salvaged(b"nothing here") == ([], [(0, 12)])


def test_mixed_archives_and_padding():
    parts = records(2, True) + [b"\0\0"] + records(2, False)
    assert salvaged(b"".join(parts)) == ([0, 1, 0, 1], [])
    assert gzip.decompress(records(1, True)[0]).startswith(b"WARC/1.1\r\n")


# ---- SentencePiece


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_scan.Lattice(PIECES)


def slow_best(lattice, text):
    """Best score and ids over the whole text, with ties to the longest last piece."""
    text = lattice.normalised(text)
    best, back = lattice.forward(text, 0, [0])
    pieces, at = [], len(text)
    while at:
        pieces.append(text[at - back[at]:at])
        at -= back[at]
    return lattice.ids_of(pieces[::-1]), best[-1]


TEXTS = ["", "a", " ", "  a   b ", "\n\n", "Hello  world\nabc", "漢字 ñ é x", "x" * 300, " " * 40, "The theme of the other"]


def test_words_equal_the_whole_lattice(lattice):
    for text in TEXTS + [t for _, t in ODD if t and len(t) < 5000]:
        ids, score = lattice.encode(text)
        want, best = slow_best(lattice, text)
        assert np.frombuffer(ids, "<u4").tolist() == want and score == best
        assert lattice.decode(ids) == text


def test_scores_equal_the_library(lattice):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, read as a lattice
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["the", "a the", "retitioning ouen the of", "thntblere onwhst and", "Hello world again"]:
        ids, score = lattice.encode(text)
        best = sp.nbest_encode(text, nbest_size=2)[0]
        assert sum(sp.get_score(i) for i in best) == score
        assert np.frombuffer(ids, "<u4").tolist() == best


@pytest.mark.parametrize("giant, chunk, block", [(100, 17, 2), (500, 200, 64)])
def test_chunks_equal_whole_texts(spark, lattice, giant, chunk, block):
    texts = TEXTS + ["abcdefghijklm" * 40, "  a   b " * 60, "\n漢字x" * 90, "the and of " * 80]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[-1]), (99, None)], "doc_id long, text string")
    want = Counter((i, lattice.encode(t)) for i, t in list(enumerate(texts)) + [(None, texts[-1]), (99, "")])
    got = sentencepiece_scan.encode(df.withColumn("ids", F.lit(1)), PIECES, giant, chunk, block).collect()
    assert Counter((r.doc_id, (bytes(r.ids), int(r.score))) for r in got) == want


def test_matrices_combine_associatively(lattice):
    text = "abc the  other\nthing" * 3
    bodies = [(text[max(0, i - 16):i + 20], min(i, 16)) for i in range(0, len(text), 20)]
    a, b, c = (lattice.matrix(*x) for x in bodies)
    left = sentencepiece_scan.combine(sentencepiece_scan.combine(a, b), c)
    assert np.array_equal(left, sentencepiece_scan.combine(a, sentencepiece_scan.combine(b, c)))
    assert left[0, 0] == lattice.forward(text, 0, [0])[0][-1]


def test_encode_and_decode_tables(spark):
    docs = odd_docs(spark)
    encoded = sentencepiece_scan.encode(docs, PIECES)
    assert Counter((r.doc_id, r.text) for r in sentencepiece_scan.decode(encoded, PIECES).collect()) == Counter(
        (d, t or "") for d, t in ODD)
    assert sentencepiece_scan.encode(no_docs(spark), PIECES).count() == 0


# ---- pipeline


def test_stages_pass_documents_on(spark, tmp_path):
    docs = table(spark, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            left = {r.doc_id for r in docs.collect()}
            assert left <= ids and left
            ids = left
            last = docs
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in last.collect()}
    check_pieces(rows, [(d, i + [0]) for d, i in zip(texts, plain_ids(list(texts.values())))])
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {(r.doc_id, r.doc_tokens) for r in again.collect()} == {(r.doc_id, r.doc_tokens) for r in rows}


def test_both_ways_of_merging_agree():
    encode = packing.Encoder(BPE)
    assert encode.fast is not None
    slow = packing.Encoder(BPE)
    slow.fast = None
    texts = [r.text or "" for r in _documents()] + ["naïve café's 1st+2nd x" * 20, "a" * 3000, "ß" * 1200 + " ok", "漢字 и русский texte"]
    assert [encode(t) for t in texts] == [slow(t) for t in texts]
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == plain_ids(texts)


def _documents():
    import pyarrow.parquet as pq
    from types import SimpleNamespace

    return [SimpleNamespace(**r) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]


def test_an_encoder_reads_the_tokenizer_only_if_a_text_needs_it():
    encode = packing.Encoder(BPE)
    assert encode("plain words") and "tokenizer" not in vars(encode)
    assert encode("слова") and "tokenizer" in vars(encode)
    assert encode.added == [t.content for t in encode.tokenizer.get_added_tokens_decoder().values()]
