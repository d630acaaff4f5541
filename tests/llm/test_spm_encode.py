import hashlib
import random
import struct

import pyarrow.parquet as pq
import sentencepiece

from trilattice.llm import spm_encode as S

PATH = S.model_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "  ", "a", " a b", "a  b   c    d", "x" * 400, "aaaaaaaaaaaaaaaa bbbbbbbbbb", "tab\tline\n\nend ", "naïve café 漢字かな ½ 👩‍👩‍👧", "<s> </s> <unk> <0x0A>", "123 4567.89", "▁a▁▁b",
    "   lead and trail   ", "http://example.com/a?b=c&d", "　x y z", "def f(x):\n        return x\n", "\0 \x7f",
]


def test_odd_texts_equal_the_library():
    spm = S.Encoder(S.Model(open(PATH, "rb").read()), memo=3)
    for batch in (ODD, ODD[::-1]):
        for t, ids in zip(batch, spm.encode(batch)):
            assert list(ids) == LIB.encode(t), t
            assert spm.model.decode(ids) == t.replace("▁", " ")


def test_random_strings_equal_the_library():
    rng = random.Random(5)
    spm = S.Encoder(S.Model(open(PATH, "rb").read()))
    pieces = [p.replace("▁", " ") for p in (LIB.id_to_piece(rng.randrange(300, 32000)) for _ in range(3000))]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice(" aeo") for _ in range(rng.randrange(1, 20))) for _ in range(1000)]
    assert [list(i) for i in spm.encode(texts)] == LIB.encode(texts)


def test_table_equals_the_library(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    want = {i: LIB.encode(x or "") for i, x in zip(t["doc_id"], t["text"])}
    rows = S.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want) and all(r.round_trip for r in rows)
    assert all((r.n_ids, r.ids_md5) == (len(want[r.doc_id]), hashlib.md5(struct.pack(f"<{len(want[r.doc_id])}i", *want[r.doc_id])).hexdigest()) for r in rows)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "hi there", 3), (2, "hi there", 3), (2, "hi there", 3)], "doc_id long, text string, ids int")
    out = S.encoded(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out.collect()) == [("1", [], ""), *[(k, LIB.encode("hi there"), "hi there") for k in ("2", "2", "None")]]
    assert S.encoded(docs.where("false"), PATH).collect() == []


def unigram_model():
    """A small unigram model file, written by hand."""
    vocabulary = {"<unk>": 0, "▁": -3.0, "▁a": -2.5, "a": -3.1, "b": -3.3, "ab": -3.9, "▁ab": -4.8, "bab": -5.5, "ba": -4.0}
    piece = lambda p, s, k: b"\x0a" + bytes([len(b := b"\x0a" + bytes([len(p.encode())]) + p.encode() + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k]))]) + b
    return b"".join(piece(p, s, 2 if p == "<unk>" else 1) for p, s in vocabulary.items()) + b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00", vocabulary


def test_unigram_viterbi():
    data, vocabulary = unigram_model()
    lib, model = sentencepiece.SentencePieceProcessor(model_proto=data), S.Model(data)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    score = lambda ids: sum(model.scores[i] for i in ids)
    for t, ids in zip(texts, S.Encoder(model).encode(texts)):
        assert abs(score(ids) - score(lib.encode(t))) < 1e-4
        assert model.decode(ids) == t


def test_query_returns_the_ids(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = {r.doc_id: r for r in S.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for i, x in zip(t["doc_id"], t["text"]):
        assert list(rows[i].ids) == LIB.encode(x or "") and rows[i].decoded == (x or "").replace("▁", " ")


def test_long_texts_in_parts_and_groups(monkeypatch):
    monkeypatch.setattr(S, "PART", 50)
    monkeypatch.setattr(S, "GROUP", 120)
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", " the", "ing ", "é", "▁", "漢"]) for _ in range(rng.randrange(400))) for _ in range(60)] + ["x" * 500, " " * 300, ""]
    spm = S.Encoder(S.Model(open(PATH, "rb").read()))
    assert [list(i) for i in spm.encode(texts)] == LIB.encode(texts)
    assert max(sum(1 for _ in spm.model.parts(t)) for t in texts) > 3


def test_literal_marks_are_told(spark):
    docs = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None)], "doc_id long, `a.b` string").withColumnRenamed("a.b", "text")
    assert {r.doc_id: (r.decoded, r.round_trip) for r in S.encoded(docs, PATH, digests=True).collect()} == {1: ("a b", False), 2: ("a b", True), 3: ("", True)}
