import random

import xxhash

from trilattice.llm.simhash import BKTree, fingerprint, fingerprint_links, keep_distinct, keep_one, near_duplicates, shingle_set, similar_texts
from trilattice.operators.graph import connected_components


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, radius=4):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def test_fingerprints():
    rng = random.Random(3)
    texts = ["", " \n", "One", "a b c", "A b C d", "É É x y z Ab", "w " * 5000]
    texts += [" ".join(rng.choice(["ab", "Cd", "e", "ÿf"]) for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    for t in texts:
        assert fingerprint(t.encode()) == brute(t)
    long = " ".join(str(rng.random()) for _ in range(150_000))
    assert fingerprint(long.encode()) == fingerprint(long.encode() + b"\n")


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(5)]
    codes = {rng.getrandbits(64) for _ in range(n // 3)}
    while len(codes) < n:
        c = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    return sorted(codes)


def test_tree_finds_components():
    codes = clustered(random.Random(1), 400)
    want = components(codes)
    found = BKTree(codes).links(4)
    root = {c: c for c in codes} | dict(found)
    groups = {}
    for c, w in zip(codes, want):
        groups.setdefault(w, set()).add(root[c])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set(root.values())) == len(groups)


def test_sharded_links_with_tiny_chunks(spark):
    codes = clustered(random.Random(2), 300)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = components(codes)
    for most in (7, 20_000):
        parts = {r.node: r.component for r in connected_components(fingerprint_links(df, shard_rows=most), "a", "b").collect()}
        got = [parts.get(c, c) for c in signed]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_rows_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "x"), (3, base, "x"), (9, base.replace("w7 ", "W7 "), "y"), (1, None, None), (2, "", "z"), (None, "solo text here", "z"), (8, "other words", None), (8, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert [(a, c) for a, _, c in got] == [(1, 1), (2, 1), (3, 3), (5, 3), (8, 8), (8, 8), (9, 3), (None, None)]
    assert got[0][1] == "0" * 16 and all(f == f"{brute(t):016x}" for d, t, _ in rows for g, f, _ in got if d == g)
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == ["1", "3", "8", "None"]
    assert near_duplicates(docs.where("false")).collect() == []


def plain_shingles(text, n=5):
    words = (text or "").translate(str.maketrans("\t\n\v\f\r" + "".join(map(chr, range(65, 91))), " " * 5 + "".join(map(chr, range(97, 123))))).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def similar_components(texts, least=0.8):
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_similar_texts_equal_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(30, 200))] for _ in range(12)]
    texts = []
    for _ in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(own) // 25)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own).upper() if rng.random() < 0.3 else "  ".join(own))
    texts += ["", None, " \n", "a b", "A  b", "a b c", "w " * 40_000]
    assert all(len(shingle_set((t or "").encode(), 5)) == len(plain_shingles(t)) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = similar_components(texts)
    for settings in ({}, {"shard_rows": 7, "chunk_bytes": 4096}):
        got = {r.doc_id: r.component_id for r in similar_texts(docs, **settings).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_kept_rows_and_clashing_columns(spark):
    odd = ["kept_id", "a.b", "mine", "row", "kept", "node", "fp"]
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (3, base.replace("w7 ", "x ")), (3, base), (None, "alone here"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, *[f"{k}-{c}" for c in odd]) for k, (i, t) in enumerate(rows)], ["doc_id", "text", *odd])
    for keep in (keep_one, keep_distinct):
        out = keep(docs)
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == ["3", "8", "None"] + (["5"] if keep is keep_one and near_duplicates(docs).where("doc_id = 5 and component_id = 5").count() else [])
        assert keep(docs.where("false")).collect() == []
