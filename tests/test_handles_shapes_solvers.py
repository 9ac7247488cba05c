"""Handles, shapes, expression texts and the options of the solvers, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.labels import AnnotationError, Labels
from lattica.operators import convert, foreach, shape, solvers
from lattica.plans.planner import evaluate
from lattica.tensor import DENSE, SPARSE, fill_random, from_numpy
from lattica.tiling import TiledRange, Tiling

T = TiledRange((Tiling((0, 2, 5)), Tiling((0, 3, 4, 7))))


def test_handles(spark):
    a = fill_random(spark, T, 1)
    x = a.to_numpy()
    cut = a.elements((1, 2), (4, 6))
    assert np.array_equal(cut.to_numpy(), x[1:4, 2:6]) and cut.trange.elements.lower == (1, 2)
    with pytest.raises(AnnotationError):
        a.elements((1, 2), (6, 6))
    with pytest.raises(AnnotationError):
        a.elements((1, 2), (1, 6))
    assert {(r.t0, r.t1): r.stored for r in a.stored_tiles().collect()}[(1, 2)] == 9
    assert a.size_of() == 35 * 3 * 8
    z = evaluate((1 + 2j) * a["i,j"], Labels("ij"))
    assert np.array_equal(z.real().to_numpy(), x) and np.array_equal(z.imag().to_numpy(), 2 * x) and not a.imag().to_numpy().any()
    foreach.update_elements(a, lambda v: v + 1)
    foreach.update_pairs(a, fill_random(spark, T, 1), lambda v, w: v - w)
    assert (a.to_numpy() == 1).all()


def test_growth_by_a_value(spark):
    for policy in (DENSE, SPARSE):
        a = fill_random(spark, T, 2, policy)
        grown = convert.retile(a, TiledRange((Tiling((0, 6)), Tiling((0, 4, 9)))), 3.0)
        want = np.full((6, 9), 3.0)
        want[:5, :7] = a.to_numpy()
        assert np.array_equal(grown.to_numpy(), want) and grown.df.count() == 54


def test_shapes(spark):
    a = shape.from_op(spark, T, lambda i, j: i * 10 + j)
    assert {(r.t0, r.t1): r.norm for r in a.collect()} == {(0, 1): 1, (0, 2): 2, (1, 0): 10, (1, 1): 11, (1, 2): 12}  # no tile of norm 0
    assert shape.constant(spark, T, 2.0).where("norm = 2").count() == 6 and shape.constant(spark, T, 0.0).count() == 0
    cut = shape.block(a, (0, 1), (2, 3), factor=-2, order=(1, 0))
    assert {(r.t0, r.t1): r.norm for r in cut.collect()} == {(0, 0): 2, (1, 0): 4, (0, 1): 22, (1, 1): 24}


def test_text_of_expressions(spark):
    a = fill_random(spark, T, 1)
    text = (2.0 * (a["i,k"] * a["j,k"]) - a["i,k"].block((0, 0), (1, 1)) * a["j,k"]).tree()
    lines = text.split("\n")
    assert lines[0] == "sum i,k,j with 1, -1" and lines[1] == "  scaled i,k,j by 2.0" and lines[2].startswith("    product i,k,j")
    assert "tiles (0, 0) to (1, 1)" in text and "Tensor(dense, 5x7)" in text


def test_policies(spark):
    dense, sparse = fill_random(spark, T, 1), fill_random(spark, T, 2, SPARSE)
    with pytest.raises(AnnotationError):
        dense["i,j"] = sparse["i,j"] * sparse["i,j"]
    with pytest.raises(AnnotationError):
        dense["i,j"].block((0, 0), (1, 1)).assign(sparse["i,j"].block((0, 0), (1, 1)))
    sparse["i,j"] = dense["i,j"] * dense["i,j"]
    assert np.array_equal(sparse.to_numpy(), dense.to_numpy() ** 2)


def test_mask_of_a_chain_reaches_the_factors(spark):
    a = fill_random(spark, T, 1)
    x = a.to_numpy()
    mask = spark.createDataFrame([(1, 0, 1.0), (0, 1, 1.0)], "t0 int, t1 int, norm double")
    found = evaluate((a["i,k"] * a["j,k"]).set_shape(mask), Labels("ij"))
    keep = np.zeros((5, 5))
    keep[2:, :2] = keep[:2, 2:] = 1
    assert np.array_equal(found.to_numpy(), (x @ x.T) * keep) and not found.is_dense
    assert found.df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 3


def pulay(steps, options, f):
    """The same method over plain arrays."""
    x, xs, es, rs = np.array([1.0, 1.0, 0.0]), [], [], []
    for it in range(1, steps + 1):
        new = f(x)
        xs.append(new)
        es.append(new - x)
        out = new
        late = it - options.get("start", 1)
        if late > 0 and late % options.get("group", 1) < options.get("group_diis", 1):
            b = np.array([[p @ q for q in es] for p in es])
            norm = np.linalg.norm(es[-1])
            adt = options.get("attenuate", 0.0)
            damp = options.get("damp", 0.0) * (min(1.0, norm / adt) if adt else 1.0)
            b = b / abs(b).max()
            b = b + np.diag(np.diag(b)) * damp
            n = len(xs)
            system = np.block([[b, -np.ones((n, 1))], [-np.ones((1, n)), np.zeros((1, 1))]])
            c = np.linalg.solve(system, np.r_[np.zeros(n), -1])[:n]
            mix = options.get("mix", 0.0)
            out = sum(k * ((1 - mix) * v + mix * r) for k, v, r in zip(c, xs, [*rs, xs[-1]])) if mix else sum(k * v for k, v in zip(c, xs))
        rs.append(out)
        x = out
    return x


@pytest.mark.parametrize("options", [{"group": 3, "group_diis": 1}, {"start": 2}, {"damp": 0.1, "attenuate": 0.5}, {"mix": 0.3}], ids=str)
def test_extrapolation_options(spark, options):
    step = np.array([[0.5, 0.2, 0.1], [0.1, 0.6, 0.0], [0.0, 0.3, 0.4]])
    f = lambda x: step @ x + 1
    diis, x = solvers.Diis(**options), np.array([1.0, 1.0, 0.0])
    for _ in range(3):
        new = f(x)
        x = diis.extrapolate(from_numpy(spark, new), from_numpy(spark, new - x)).to_numpy()
    assert np.allclose(x, pulay(3, options, f), atol=1e-8)


def test_decomposition_helpers(spark):
    m = np.array([[4.0, 1], [1, 3]])
    assert np.allclose(solvers.cholesky_inverse(m) @ m, np.eye(2))
    m = np.array([[0.0, 2], [2, 0]])  # not positive definite
    assert np.allclose(solvers.cholesky_inverse(m) @ m, np.eye(2))
    f, lengths = solvers.normalize_factor(np.array([[3.0, 0], [4, 0]]))
    assert np.allclose(lengths, [5, 0]) and np.allclose(f, [[0.6, 0], [0.8, 0]])
    parts = [np.random.default_rng(k).random((e, 2)) for k, e in enumerate((4, 3, 3))]
    cp = solvers.Cp(from_numpy(spark, np.einsum("ir,jr,kr->ijk", *parts)), ridge=0.01)
    assert cp.compute_rank(2, 1e-4, 15) < 0.05


def test_tiles_of_uneven_marks(spark):
    few = Tiling((-3, 0, 1, 5, 6, 13))
    many = Tiling(tuple(k * k for k in range(140)))
    for t in (few, many):
        found = spark.range(t.lower, t.upper).select("id", t.tile_column(F.col("id")).alias("t")).collect()
        assert all(r.t == t.tile_of(r.id) for r in found)
    s = shape.norms(fill_random(spark, TiledRange((Tiling((0, 2, 5, 7)), Tiling((0, 5, 6, 10)))), 1))
    assert shape.mask(s, s.where("t0 = 1")).count() == 3  # of itself
