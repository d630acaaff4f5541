import numpy as np
import pytest

from trilattice.llm import embed_lattice as E


def brute(rows, threshold=0.98):
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 3
    got = E.decode_e8(x)
    assert ((got * 2) % 1 == 0).all() and (got.sum(axis=1) % 2 == 0).all()
    d = ((x - got) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()
    assert all((((x - got - v) ** 2).sum(axis=1) >= d - 1e-9).all() for v in E.NEAREST)


def rows(dim=16):
    rng, out = np.random.default_rng(2), []
    centres = rng.normal(size=(6, dim))
    for i in range(160):
        v = centres[rng.integers(6)] * rng.choice([1, 2]) + rng.normal(size=dim) * rng.choice([0.05, 0.14, 2.0])
        out.append((1000 - i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    out += [(7, out[0][1], out[0][2]), (7, out[0][1], out[0][2]), (None, out[0][1], out[0][2]), (1, None, 0), (2, [0.0] * dim, 0), (3, [float("nan")] * dim, 0), (4, [], 0), (5, out[0][1], None), (6, out[0][1], None)]
    return [*out, (8, [*out[0][1][1:], None], 0), (9, [float("inf"), *out[0][1][1:]], 0), (10, out[0][1][:5], 0), (11, out[0][1][:5], 0)]


@pytest.mark.parametrize("kind, chunk", [("float", 2048), ("double", 5)])
def test_equals_brute_force(spark, kind, chunk):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], f"vec_id long, embedding array<{kind}>, label int, node int")
    got = sorted((tuple(r) for r in E.near_vectors(df, chunk=chunk).collect()), key=str)
    assert got == brute(data)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
