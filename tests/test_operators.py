import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.labels import AnnotationError, Labels
from lattica.operators import convert, foreach, linalg, shape, solvers
from lattica.operators import reduce as R
from lattica.plans.einsum import einsum
from lattica.plans.planner import evaluate
from lattica.tensor import DENSE, SPARSE, Tensor, diagonal, fill, fill_random, from_numpy, init_elements, init_tiles, nested
from lattica.tiling import TiledRange, Tiling

T = TiledRange((Tiling((0, 2, 5, 7)), Tiling((0, 5, 7, 10, 12))))


def test_constructors(spark):
    assert np.array_equal(fill(spark, T, 2.0).to_numpy(), np.full((7, 12), 2.0))
    assert fill(spark, T, 0.0, SPARSE).df.count() == 0
    assert np.array_equal(init_elements(spark, T, lambda i, j: i * 100 + j).to_numpy(), np.add.outer(np.arange(7) * 100, np.arange(12)))
    a, b = fill_random(spark, T, 3), fill_random(spark, T, 3)
    assert np.array_equal(a.to_numpy(), b.to_numpy()) and a.to_numpy().max() <= 100
    made = init_tiles(spark, T, lambda bounds: None if bounds[0][0] == 0 else np.full((1, 1), bounds[1][0]))
    assert made.to_numpy()[0].sum() == 0 and made.to_numpy()[2, 5] == 5
    d = diagonal(spark, TiledRange.uniform((4, 6), 3), [1.2, 1.3, 1.4]).to_numpy()
    assert [d[k, k] for k in range(4)] == [1.2, 1.3, 1.4, 0.0]
    assert np.array_equal(from_numpy(spark, [[1, 2], [3, 4]]).to_numpy(), [[1, 2], [3, 4]])
    assert np.array_equal(from_numpy(spark, [1, 2, 3, 4], TiledRange.whole((2, 2)), order="F").to_numpy(), [[1, 3], [2, 4]])
    assert fill(spark, TiledRange((Tiling.whole(3), Tiling(()))), 1.0).df.count() == 0


def test_save_and_load(spark, tmp_path):
    a = fill_random(spark, T, 1, SPARSE)
    a.save(f"file://{tmp_path}/a")
    b = Tensor.load(spark, f"file://{tmp_path}/a")
    assert b.trange == a.trange and b.policy == SPARSE and np.array_equal(a.to_numpy(), b.to_numpy())


def test_reductions(spark):
    x = np.random.default_rng(1).integers(-50, 50, (7, 12)).astype(float)
    a = from_numpy(spark, x, T)["i,j"]
    assert (a.sum(), a.min(), a.max(), a.abs_min(), a.abs_max(), a.squared_norm()) == (x.sum(), x.min(), x.max(), np.abs(x).min(), np.abs(x).max(), (x * x).sum())
    assert a.norm() == pytest.approx(np.sqrt((x * x).sum())) and a.trace() == np.trace(x) and a.volume() == x.size
    assert fill(spark, T, -3.0)["i,j"].max() == -3.0  # the true maximum, not a smallest positive number
    assert fill(spark, TiledRange.whole((2, 2)), 3.0)["i,j"].product() == 81
    assert a.dot(a) == (x * x).sum() and a.reduce(F.lit(0.0), lambda p, q: p + q) == x.sum()
    assert a.reduce(F.lit(0.0), lambda p, q: p + q, other=a, element=lambda p, q: p - q) == 0


def test_zeros_of_stored_tiles_count(spark):
    trange = TiledRange.uniform((4, 4), 2)
    df = spark.createDataFrame([(0, 0, 5.0), (1, 1, 7.0)], "i0 bigint, i1 bigint, v double")
    part = Tensor(df, trange)["i,j"]
    assert part.min() == 0 and part.product() == 0 and part.abs_min() == 0 and part.max() == 7
    full = Tensor(spark.createDataFrame([(i, j, 3.0) for i in (0, 1) for j in (0, 1)], "i0 bigint, i1 bigint, v double"), trange)["i,j"]
    assert full.min() == 3 and full.product() == 81  # tiles that are not stored do not count
    assert Tensor(df.where("v > 9"), trange)["i,j"].sum() == 0 and Tensor(df.where("v > 9"), trange)["i,j"].min() is None


def test_trace_with_unequal_lower_bounds(spark):
    x = np.arange(12.0).reshape(3, 4)
    t = from_numpy(spark, x, TiledRange((Tiling((1, 2, 4)), Tiling((0, 3, 4)))))
    assert t["i,j"].trace() == x[0, 1] + x[1, 2] + x[2, 3]


def test_ternary_dot(spark):
    a, b, c = (fill_random(spark, TiledRange.whole((2, 3, 3)), k) for k in (1, 2, 3))
    x, y, z = a.to_numpy(), b.to_numpy(), c.to_numpy()
    want = np.einsum("hik,hkj,hji->", x, y, z)
    assert R.ternary_dot("hik,hkj,hji", a, b, c).collect()[0].value == want
    assert R.ternary_dot("hkj,hji,hik", b, c, a).collect()[0].value == want


def test_conversions(spark):
    x = np.random.default_rng(2).integers(1, 50, (7, 12)).astype(float)
    a = from_numpy(spark, x, T)
    assert np.array_equal(convert.retile(a, TiledRange((Tiling((0, 4, 6)), Tiling((0, 2, 12))))).to_numpy(), x[:6])
    grown = convert.retile(a, TiledRange((Tiling((0, 9)), Tiling((0, 12)))))
    assert grown.df.count() == 9 * 12 and grown.to_numpy()[8].sum() == 0
    assert np.array_equal(convert.concat([a, a], [0]).to_numpy(), np.concatenate([x, x]))
    both = convert.concat([a, a], [0, 1]).to_numpy()
    assert np.array_equal(both[:7, :12], x) and np.array_equal(both[7:, 12:], x) and not both[:7, 12:].any()
    s = convert.stack([a, convert.shift(a, (0, 0))])
    assert np.array_equal(convert.split(s, 1).to_numpy(), x)
    assert np.array_equal(convert.replicate(a, (2,)).to_numpy(), np.stack([x, x]))
    assert np.array_equal(convert.delta_select(a, 0, 3).to_numpy(), x[3])
    y = x.copy()
    y[:2, :5] = 0
    sparse = convert.to_sparse(from_numpy(spark, y, T))
    assert sparse.df.count() == y.size - 10 and convert.to_dense(sparse).df.count() == y.size
    assert convert.truncate(from_numpy(spark, y, T)).df.count() == y.size  # dense: unchanged
    with pytest.raises(AnnotationError):
        convert.concat([a, from_numpy(spark, x)], [0])


def test_shapes(spark):
    x = np.random.default_rng(2).integers(1, 50, (7, 12)).astype(float)
    x[:2, :5] = 0
    a = from_numpy(spark, x, T, SPARSE)
    n = {(r.t0, r.t1): r.norm for r in shape.norms(a).collect()}
    for tile in T.tiles:
        box = T.tile_range(tile)
        cut = x[tuple(slice(p, q) for p, q in zip(box.lower, box.upper))]
        assert n.get(tile, 0) == pytest.approx(np.linalg.norm(cut) / cut.size)
    s = shape.norms(a)
    assert shape.sparsity(s, T) == pytest.approx(1 / 12)
    other = s.where("t0 = 1")
    assert shape.mask(s, other).count() == 4 and shape.scale(s, 1e-12).count() == 0
    assert shape.block(s, (1, 1), (3, 3)).count() == 4 and shape.permute(s, (1, 0)).where("t0 = 3").count() == 3
    assert shape.update_block(s, (1, 0), (2, 4), shape.block(s, (2, 0), (3, 4))).where("t0 = 1").count() == 4
    assert shape.add_constant(s, T, 1.0).count() == 12
    prod = shape.gemm(s, Labels("ik"), T, s, Labels("jk"), Labels("ij"))
    true = {(r.t0, r.t1): r.norm for r in shape.norms(evaluate(a["i,k"] * a["j,k"], Labels("ij"))).collect()}
    sizes = T.modes[0].sizes()
    for r in prod.collect():  # a bound of the product's norms
        assert r.norm * sizes[r.t0] * sizes[r.t1] >= true[r.t0, r.t1] * sizes[r.t0] * sizes[r.t1] * 0.99 / max(sizes) ** 2
    assert shape.from_norms(spark, {(0, 0): 20.0, (1, 1): 0.0}, T).count() == 1


def test_screening_is_lossy(spark):
    s = shape.from_norms(spark, {(0, 0): 1.0}, T)
    assert shape.scale(shape.scale(s, 1e-10), 1e10).count() == 0


def test_foreach(spark):
    a = fill_random(spark, T, 1)
    x = a.to_numpy()
    assert np.array_equal(foreach.map_elements(a, lambda v: v * v).to_numpy(), x * x)
    half = Tensor(a.df.where("i0 < 3"), T)
    assert foreach.zip_elements(half, a, lambda p, q: p + q).df.count() == 36
    union = foreach.zip_elements(half, a, lambda p, q: p - q, foreach.UNION).to_numpy()
    assert not union[:3].any() and np.array_equal(union[3:], -x[3:])
    tiles = foreach.map_tiles(a, lambda t, bounds: t[::-1] if bounds[0][0] else None).to_numpy()
    assert not tiles[:2].any() and np.array_equal(tiles[2:5], x[2:5][::-1])


def test_tensors_of_tensors(spark):
    """Jagged cells: extents (2 + i % 2); cell 0 is empty."""
    trange = TiledRange((Tiling((0, 2, 4)),))
    a = nested(spark, trange, lambda i: [F.when(i == 0, 0).otherwise(2 + i % 2)], lambda i, n: i * 10 + n)
    cells = {i: [i * 10 + n for n in range(2 + i % 2)] for i in range(1, 4)}
    got = {r.i0: r.v for r in evaluate(a["i;n"].dot_inner(a["i;n"]), Labels("i")).df.collect()}
    assert got == {i: sum(v * v for v in c) for i, c in cells.items()}
    outer = evaluate(a["i;m"] * a["i;n"], Labels("i"), Labels("mn")).df.where("i0 = 1").count()
    assert outer == 9
    weights = from_numpy(spark, np.arange(4.0), trange, SPARSE)
    scaled = evaluate(weights["i"] * a["i;n"], Labels("i"), Labels("n")).df.collect()
    assert all(r.v == r.i0 * cells[r.i0][r.n0] for r in scaled)
    denested = einsum(a["i;n"], a["j;n"], "i,j", denest=True).to_numpy()
    assert denested[1, 2] == sum(p * q for p, q in zip(cells[1], cells[2]))


def test_linear_algebra(spark):
    rng = np.random.default_rng(3)
    m = rng.random((6, 6))
    spd = m @ m.T + 6 * np.eye(6)
    a, b = from_numpy(spark, spd), from_numpy(spark, rng.random((6, 2)))
    low, inv = linalg.cholesky_linv(a, both=True)
    assert np.allclose(low.to_numpy() @ low.to_numpy().T, spd) and np.allclose(inv.to_numpy() @ low.to_numpy(), np.eye(6))
    for solve in (linalg.cholesky_solve, linalg.lu_solve, linalg.qr_solve):
        assert np.allclose(spd @ solve(a, b).to_numpy(), b.to_numpy())
    low, y = linalg.cholesky_lsolve(a, b)
    assert np.allclose(low.to_numpy() @ y.to_numpy(), b.to_numpy())
    e, v = linalg.heig(a)
    assert np.allclose(spd @ v.to_numpy(), v.to_numpy() * e) and (np.diff(e) >= 0).all()
    other = from_numpy(spark, np.eye(6) * 2)
    e, v = linalg.heig(a, other)
    assert np.allclose(spd @ v.to_numpy(), 2 * v.to_numpy() * e) and np.allclose(v.to_numpy().T @ (2 * v.to_numpy()), np.eye(6))
    s, u, vt = linalg.svd(from_numpy(spark, m))
    assert np.allclose(u.to_numpy() * s @ vt.to_numpy(), m) and (np.diff(s) <= 0).all()
    assert len(linalg.svd(a, "values")) == 1 and len(linalg.svd(a, "left")) == 2
    tall = from_numpy(spark, rng.random((20, 3)))
    for qr in (linalg.householder_qr, linalg.cholesky_qr):
        q, r = qr(tall)
        assert np.allclose(q.to_numpy() @ r.to_numpy(), tall.to_numpy()) and np.allclose(q.to_numpy().T @ q.to_numpy(), np.eye(3))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.cholesky(from_numpy(spark, -spd))


def test_circulant_spectrum(spark):
    n, c = 48, np.random.default_rng(5).random(25)
    c[0] = 100
    row = np.concatenate([c[:25], c[1:24][::-1]])
    matrix = np.array([np.roll(row, k) for k in range(n)])
    values, _ = linalg.heig(from_numpy(spark, matrix, TiledRange.uniform((n, n), 16)))
    want = sorted((row * np.cos(2 * np.pi * np.arange(n) * k / n)).sum() for k in range(n))
    assert np.allclose(values, want)


def test_conjugate_gradient_and_diis(spark):
    m = np.array([[1.0, 2, 3], [2, 5, 8], [3, 8, 15]])
    a, b = from_numpy(spark, m), from_numpy(spark, np.array([1.0, 4, 0]))
    apply = lambda v: evaluate(a["i,j"] * v["j"], Labels("i"))
    x = solvers.conjugate_gradient(apply, b, from_numpy(spark, np.zeros(3)), from_numpy(spark, np.ones(3)), 1e-11)
    assert np.allclose(x.to_numpy(), [-6.5, 9, -3.5], atol=1e-8)
    # a linear fixed point in two dimensions is hit by extrapolation of three vectors
    diis, v = solvers.Diis(), from_numpy(spark, np.array([1.0, 1.0]))
    step = np.array([[0.5, 0.2], [0.1, 0.6]])
    for _ in range(4):
        now = v.to_numpy()
        v = diis.extrapolate(from_numpy(spark, step @ now + 1), from_numpy(spark, step @ now + 1 - now))
    assert np.allclose(v.to_numpy(), np.linalg.solve(np.eye(2) - step, [1, 1]), atol=1e-6)


def test_cp(spark):
    ones = fill(spark, TiledRange.uniform((5, 4, 3), 2), 1.0)
    cp = solvers.Cp(ones)
    assert cp.compute_rank(1) < 1e-6 and np.allclose(cp.reconstruct().to_numpy(), 1)
    f = [np.random.default_rng(k).random((e, 2)) for k, e in enumerate((5, 4, 3))]
    cp = solvers.Cp(from_numpy(spark, np.einsum("ir,jr,kr->ijk", *f)))
    assert cp.compute_error(0.02, 3, 1e-5) <= 0.02 and len(cp.get_factor_matrices()) == 3
    assert np.allclose(solvers.pseudo_inverse(np.array([[2.0, 0], [0, 0]])), [[0.5, 0], [0, 0]])


def test_streamed_sums(spark, tmp_path):
    from lattica.streaming.accumulate import accumulate, accumulated, compacted

    source = tmp_path / "in"
    a = fill_random(spark, T, 1)
    for k in (1, 2):
        a.df.withColumn("v", F.col("v") * k).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(a.df.schema).parquet(str(source))
        accumulate(stream, 2, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = accumulated(spark, str(tmp_path / "out"), T)
    assert np.array_equal(found.to_numpy(), 3 * a.to_numpy())
    assert np.array_equal(compacted(spark, str(tmp_path / "out"), str(tmp_path / "one"), T).to_numpy(), 3 * a.to_numpy())
