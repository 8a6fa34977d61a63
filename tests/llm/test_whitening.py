import math

import numpy as np
import pytest

from ledgerlens.llm import whitening
from ledgerlens.llm.queries import op12_embedding_whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    full = [(i, v, "x", "y", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, x string, component string, label int")


def query(spark, rows, scratch):
    table(spark, rows).repartition(3).write.parquet(f"{scratch}/embeddings.parquet")
    out = op12_embedding_whitening(spark, scratch)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    return out.collect()


def some(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2).astype(np.float32)


def brute(vectors):
    """(x of every row, n, S, eigenvalues, eigenvectors, trace) in Python integers and one eigh."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n ** 3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    return x, n, s, values[::-1], axes[:, ::-1], np.trace(cov)


def test_query_against_brute_force(spark, scratch):
    v = some(150, 20)
    v[40:60] = v[3]  # copies count once
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)] + [(5, [float(c) for c in v[5]])]
    bad = [(900, None), (901, [NAN] + [0.0] * 19), (902, [None] + [0.0] * 19), (903, [INF] + [0.0] * 19), (904, [1.0, 2.0]), (905, [])]
    x, n, s, values, axes, trace = brute(v)
    got = query(spark, rows + bad, scratch)
    assert len(got) == 16 * 151 and {r["n"] for r in got} == {n}
    assert {r["vec_id"] for r in got} == set(range(150))
    sign = {}
    for r in got:
        k, xi = r["component"] - 1, x[r["vec_id"]]
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(xi, s))
        want = sum((a - b / n) * axes[j, k] for j, (a, b) in enumerate(zip(xi, s))) / math.sqrt(values[k])
        if abs(want) > 1e-6:
            assert sign.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("spread", [1, 40, 10 ** 6, 10 ** 12])
def test_scatter_is_exact(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, size=(130, 5))
    x[:, 3] = 7  # a constant dimension has no plane
    sums, products = whitening.scatter(x)
    big = x.astype(object)
    assert sums == list(big.sum(axis=0)) and products == (big.T @ big).tolist()


def test_one_vector_constant_dimension_and_empty(spark, scratch):
    assert query(spark, [(1, [0.5, 0.25])] * 3, scratch + "/one") == []  # no variance
    assert query(spark, [], scratch + "/none") == []
    assert query(spark, [(1, None)], scratch + "/null") == []
    got = query(spark, [(i, [i / 7, 2.0, -i * i / 9]) for i in range(30)], scratch + "/flat")
    assert {r["component"] for r in got} == {1, 2}  # the constant dimension has no component


def test_wide_values_stay_exact(spark, scratch):
    """Entries of very different size, beyond what doubles could sum exactly."""
    rows = [(i, [float(np.float32(3e9 * i)), float(i % 3)]) for i in range(9)]
    x, n, s, *_ = brute([v for _, v in rows])
    model = whitening.fit(table(spark, rows))
    got = {r["id"]: int(r["deviation"]) for r in whitening.whiten(table(spark, rows), model).collect()}
    assert got == {i: sum((n * a - b) ** 2 for a, b in zip(xi, s)) for i, xi in enumerate(x)}
    assert len(model.values) == 1  # beside 1e23 the second variance is rounding
    assert whitening.whiten(table(spark, [(1, [1e38, 0.0])]), model).count() == 1  # saturates, no crash
