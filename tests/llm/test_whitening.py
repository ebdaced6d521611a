from fractions import Fraction

import numpy as np
import pytest

from caseflow.llm import whitening
from conftest import TABLES

SCHEMA = "vec_id long, embedding array<float>, component string, n string, whitened string, dims string"


def brute(rows, most=32):
    """{(vec_id, component): (deviation, |whitened|, explained)} in exact arithmetic up to the eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in kept if len(v) == dims]
    n = len(kept)
    sums = [sum(x[d] for _, x in kept) for d in range(dims)]
    away = [[n * x[d] - sums[d] for d in range(dims)] for _, x in kept]
    cov = [[Fraction(sum(a[i] * a[j] for a in away), n**3) for j in range(dims)] for i in range(dims)]
    values, found = np.linalg.eigh(np.asarray([[float(c) for c in row] for row in cov]))
    trace = float(sum(cov[d][d] for d in range(dims)))
    out = []
    for (i, _), a in zip(kept, away, strict=True):
        for k in range(min(most, dims)):
            e, unit = values[-1 - k], found[:, -1 - k]
            alone = e > dims * np.finfo(float).eps * values[-1]
            z = abs(float(np.asarray([v / n for v in a]) @ unit)) / np.sqrt(e) if alone else 0.0
            out.append((str(i), k + 1, n, sum(v * v for v in a), z, e / trace if alone else 0.0))
    return sorted(out)


def check(frame, rows):
    found = frame.collect()
    got = sorted(
        (str(r["vec_id"]), r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in found
    )
    wanted = brute(rows)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-6, abs=1e-9)
    assert len({r["identity_error"] for r in found}) <= 1
    assert all(0 <= r["identity_error"] <= 1e-9 for r in found)


def test_block_sums_are_exact():
    chance = np.random.default_rng(4)
    for rows, dims, low, high in ((1, 3, -5, 5), (64, 4, 0, 2), (1000, 7, -40, 41), (130, 5, -(2**61), 2**61), (9, 2, 3, 4)):
        x = chance.integers(low, high, (rows, dims))
        sums, products = whitening.block_sums(x)
        exact = x.astype(object)
        assert list(sums) == list(exact.sum(axis=0))
        assert (products == exact.T @ exact).all()


def test_planes_hold_each_bit_of_each_row():
    x = np.asarray([[5, 0, 1], [2, 0, 0], [7, 0, 1]], np.uint64)
    planes, dimension, bits = whitening.bit_planes(x)
    assert sorted(zip(dimension.tolist(), bits.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (2, 0)]
    assert np.bitwise_count(planes).sum() == sum(int(v).bit_count() for v in x.ravel())


def test_against_exact_arithmetic(spark):
    chance = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(c)) for c in chance.normal(0.3, 1 + np.arange(6), 6)]) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (200, None), (201, [1.0, nan, 0, 0, 0, 0]), (202, [inf, 0, 0, 0, 0, 0]), (203, [0, -inf, 0, 0, 0, 0]),
        (204, [1.0, None, 0, 0, 0, 0]), (205, []), (206, [1.0, 2.0]), (None, rows[0][1]), rows[3], rows[3],
        (-7, [1000.0, -3.0, 0.0, 0.015625, 2.0, -0.001]),
    ]
    frame = spark.createDataFrame(
        [(i, v and [None if c is None else float(c) for c in v] if v else v, "a", "b", "c", "d") for i, v in rows], SCHEMA
    ).repartition(5)
    check(whitening.whitening(frame), rows)


def test_without_variance_and_without_rows(spark):
    alike = [(i, [0.5, -0.25, 3.0]) for i in range(4)]
    frame = spark.createDataFrame([(*r, "", "", "", "") for r in alike], SCHEMA)
    found = whitening.whitening(frame).collect()
    assert len(found) == 12
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(4, 0, 0.0, 0.0, 0.0)}
    one = spark.createDataFrame([(1, [2.0, 1.0, 0.0, 1.0], "", "", "", ""), (2, [0.0] * 4, "", "", "", "")], SCHEMA)
    check(whitening.whitening(one), [(1, [2.0, 1.0, 0.0, 1.0]), (2, [0.0] * 4)])
    assert whitening.whitening(frame.limit(0)).count() == 0
    assert whitening.whitening(frame.where("vec_id < 0")).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_large_entries(spark):
    large = [(i, [float(2**40) * (-1) ** i, float(i)]) for i in range(6)]
    frame = spark.createDataFrame([(*r, "", "", "", "") for r in large], SCHEMA)
    found = {r["deviation"] for r in whitening.whitening(frame).collect()}
    assert found == {None}  # beyond a long
    fitted = whitening.fit(whitening.vectors(frame))
    exact = whitening.whitened(whitening.vectors(frame), fitted).collect()
    assert {int(r["deviation"]) > 2**63 for r in exact} == {True}
    too_large = spark.createDataFrame([(1, [1e30, 0.0], "", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="OverflowError"):
        whitening.whitening(too_large)


def test_the_query_on_tables(spark):
    found = whitening.op12_embedding_whitening(spark, TABLES)
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    x = np.floor(64 * np.asarray([r["embedding"] for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    table = found.toPandas().sort_values(["vec_id", "component"])
    assert len(table) == 32 * n and set(table["n"]) == {n}
    ids = np.argsort([r["vec_id"] for r in rows])
    deviation = ((n * x - sums) ** 2).sum(axis=1)[ids]
    assert (table["deviation"].to_numpy().reshape(n, 32) == deviation[:, None]).all()
    z = table["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(z.T @ z / n - np.eye(32)).max() < 1e-9
    away = (n * x - sums)[ids] / n
    cov = away.T @ away / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert table["explained"].to_numpy()[:32] == pytest.approx(values[:32] / np.trace(cov), rel=1e-9)
    # Each component is a multiple of a projection: whitened times sqrt(e) has the eigenvalue as variance.
    back = np.linalg.lstsq(away, z, rcond=None)[0] * np.sqrt(values[:32])
    assert np.abs(np.linalg.norm(back, axis=0) - 1).max() < 1e-9
