import sys
from collections import Counter
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import similar_components
from trilattice.llm import quality_rules, spm_encode, toxicity
from trilattice.session import stored

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_code(spark):
    docs = P.table(spark, SF, "documents")
    columns, labels = docs.columns, P.table(spark, SF, "labels")
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        after = stored(stage(spark, docs, SF), "t")
        rows = [tuple(r) for r in after.collect()]
        if name != "sentencepiece":
            assert after.columns == columns and not Counter(rows).keys() - Counter(before).keys()
        if name == "toxicity":
            s = toxicity.fit_on(docs, labels).prepare()
            assert Counter(rows) == Counter(r for r in before if s.score(r[1] or "") < 0.7)
        elif name == "quality":
            good = {r.doc_id for r in quality_rules.scored(docs, quality_rules.fit_on(docs, labels)).collect() if r.score >= 0.3}
            assert Counter(rows) == Counter(r for r in before if r[0] in good)
        elif name == "near_copies":
            before.sort()
            groups = similar_components([r[1] for r in before])
            assert sorted(rows) == [r for i, r in enumerate(before) if groups[i] == i]
        elif name == "mixing":
            size = lambda r: len((r[1] or "").encode().split())
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r[3]] += size(r)
            for r in rows:
                got[r[3]] += size(r)
            want, longest = plain_targets(sizes), max(map(size, before))
            assert max(Counter(rows).values()) <= 3 and all(abs(got[s] - want[s]) <= longest for s in sizes)
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=spm_encode.model_path())
            assert Counter((r[0], tuple(r[3])) for r in rows) == Counter((r[0], tuple(lib.encode(r[1] or ""))) for r in before)
        docs = after
    assert P.run(spark, SF).count() == len(rows)


def test_stages_over_odd_rows_and_columns(spark):
    odd = ["__mix", "__size", "__key", "__copy", "kept_id", "a.b", "__q_words", "score", "node"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in base] + [(base[0].doc_id, base[0].text, None, None), (None, None, None, None), (None, "a text without id", "en", None), (900001, "", "en", "s"), (900002, "word " * 60_000, "en", "s")]
    docs = spark.createDataFrame([(*r, *[f"{i}-{c}" for c in odd]) for i, r in enumerate(rows)], ["doc_id", "text", "lang", "source", *odd])
    for given in (docs, docs.where("false")):
        for name, stage in P.STAGES:
            before = Counter(tuple(r) for r in given.collect())
            after = stage(spark, given, SF)
            if name == "sentencepiece":
                assert after.columns == ["doc_id", "lang", "source", "ids"] and after.count() == sum(before.values())
            else:
                assert after.columns == docs.columns
                got = Counter(tuple(r) for r in after.collect())
                assert not got.keys() - before.keys() and all(n <= 3 * before[r] if name == "mixing" else n <= before[r] for r, n in got.items())
