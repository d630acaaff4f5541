"""What an encoding worker holds."""

import random
import tracemalloc

from trilattice.llm import spm_encode as E


def test_words_of_a_group_are_not_all_held():
    """4 M characters of few distinct words: their list alone would be some 45 MB."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=7000)) for _ in range(100)]
    spm = E.Encoder(E.Model(open(E.model_path(), "rb").read()))
    tracemalloc.start()
    ids = spm.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [spm.model.decode(x) for x in ids[:3]] == texts[:3]
    assert peak < 30 << 20, peak


def test_ids_alone(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    whole, ids = E.encoded(docs, E.model_path()), E.encoded(docs, E.model_path(), decode=False)
    assert ids.columns == ["doc_id", "text", "ids"]
    assert sorted(ids.collect()) == sorted(whole.drop("decoded").collect())
