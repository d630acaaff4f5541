import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from trilattice.llm.token_count import PieceCounter, op9_token_counts, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "\n\n x", "x \n y", " \t ", "don't we'll 'sun 's", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>  b <|endoftext|",
    "é ü 漢字かな 12345 ½²Ⅷ", "a b  c　 d\x85e \x1c f\x1f g", "x" * 3000, "‍👩‍👩‍👧 ok", "tab\tend ", "\r\n\r\n", "a  b", " 's 't", "__ a_b 3d4 --- !!!", "\0 \0a b\0 c",
]


def test_odd_texts_match_the_library():
    lib = Tokenizer.from_file(PATH)
    counter = PieceCounter(PATH, memo=5)
    assert counter.counts(ODD) == [len(lib.encode(t, add_special_tokens=False).ids) for t in ODD]
    assert counter.counts([]) == []


def test_whole_table_matches_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    want = {i: len(lib.encode(x or "", add_special_tokens=False).ids) for i, x in zip(t["doc_id"], t["text"])}
    rows = op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_nulls_repeats_and_other_vocabularies(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "a b", 5), (2, "a b", 5)], "doc_id long, text string, n_bytes long")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert got == [("1", 0, 0), ("2", 3, 2), ("2", 3, 2), ("None", 3, 2)]
    assert token_counts(docs.where("false"), PATH).collect() == []
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert PieceCounter(str(public_tokenizers.path(name))).counts(["hello world", ""])[0] >= 2
