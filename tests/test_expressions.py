"""Expressions against numpy on whole numbers, on irregular tilings, dense and with tiles left out."""

import numpy as np
import pytest

from lattica.labels import AnnotationError, Labels
from lattica.plans.blocks import tile_product
from lattica.plans.einsum import einsum
from lattica.plans.planner import evaluate
from lattica.tensor import DENSE, SPARSE, Tensor, from_numpy
from lattica.tiling import TiledRange, Tiling

A = Tiling((0, 2, 5))
B = Tiling((0, 3, 4, 7))


def make(spark, seed, *modes, policy=SPARSE):
    rng = np.random.default_rng(seed)
    trange = TiledRange(modes)
    array = rng.integers(0, 101, trange.elements.extents).astype(float)
    if policy == SPARSE:
        for tile in trange.tiles:
            if rng.random() < 0.4:
                box = trange.tile_range(tile)
                array[tuple(slice(a, b) for a, b in zip(box.lower, box.upper))] = 0
    return from_numpy(spark, array, trange, policy), array


@pytest.mark.parametrize("policy", [DENSE, SPARSE])
@pytest.mark.parametrize("spec", ["ik,jk->ij", "ik,kj->ji", "hik,hkj->hij", "hi,hi->h", "hk,h->hk", "i,j->ij", "ij,ji->ij", "ij,ij->i"])
def test_products(spark, spec, policy):
    modes = {"i": A, "j": B, "k": Tiling((0, 2, 3, 6)), "h": Tiling((0, 1, 4))}
    left, right = spec.split("->")[0].split(",")
    a, x = make(spark, 1, *(modes[c] for c in left), policy=policy)
    b, y = make(spark, 2, *(modes[c] for c in right), policy=policy)
    assert np.array_equal(einsum(spec, a, b).to_numpy(), np.einsum(spec, x, y))


@pytest.mark.parametrize("spec", ["ik,jk,jl->il", "ijk,k,k->ij", "pr,qr,rs,ts,us->pqtu", "ik,kj,ab->ijab"])
def test_n_ary_products(spark, spec):
    modes = dict.fromkeys("ijklabpqrstu", Tiling((0, 1, 3)))
    made = [make(spark, n, *(modes[c] for c in part), policy=DENSE) for n, part in enumerate(spec.split("->")[0].split(","))]
    assert np.array_equal(einsum(spec, *(t for t, _ in made)).to_numpy(), np.einsum(spec, *(x for _, x in made)))


def test_label_wanted_later_stays_fused(spark):
    a, x = make(spark, 1, A, A, A)
    b, y = make(spark, 2, A)
    tree = a["i,j,k"] * b["k"] * b["k"]
    assert np.array_equal(evaluate(tree, Labels("ij")).to_numpy(), np.einsum("ijk,k,k->ij", x, y, y))
    with pytest.raises(AnnotationError):
        evaluate(a["i,j,k"] * b["k"], Labels("i"))


def test_sums_and_factors(spark):
    a, x = make(spark, 1, A, B)
    b, y = make(spark, 2, B, A)
    c = Tensor(None, a.trange)
    c["i,j"] = 2 * (a["i,j"] - 3 * b["j,i"]) / 4 + -a["i,j"]
    assert np.array_equal(c.to_numpy(), 2 * (x - 3 * y.T) / 4 - x)
    c["j,i"] = c["i,j"]
    assert c.extents == (7, 5)
    with pytest.raises(AnnotationError):
        _ = evaluate(a["i,j"] + b["i,j"], Labels("ij"))
    with pytest.raises(AnnotationError):
        a["i"]


def test_mixed_policies_are_refused_in_sums(spark):
    a, _ = make(spark, 1, A, B)
    b, _ = make(spark, 2, A, B, policy=DENSE)
    with pytest.raises(AnnotationError):
        evaluate(a["i,j"] + b["i,j"], Labels("ij"))


def test_complex(spark):
    rng = np.random.default_rng(4)
    x, y = (rng.integers(-9, 9, (4, 3)) + 1j * rng.integers(-9, 9, (4, 3)) for _ in range(2))
    a, b = from_numpy(spark, x), from_numpy(spark, y)
    assert np.array_equal(evaluate((2j * a["i,k"]) * b["j,k"].conj(), Labels("ij")).to_numpy(), 2j * x @ y.conj().T)
    assert a["i,j"].inner_product(b["i,j"]) == np.vdot(x, y) and a["i,j"].dot(b["i,j"]) == (x * y).sum()
    assert a["i,j"].conj().conj().labels() == a["i,j"].labels()
    assert np.array_equal(evaluate(a["i,j"] + from_numpy(spark, x.real)["i,j"], Labels("ij")).to_numpy(), x + x.real)


def test_blocks(spark):
    a, x = make(spark, 1, A, B, policy=DENSE)
    cut = a["i,j"].block((1, 0), (2, 2))
    assert np.array_equal(evaluate(cut, Labels("ij")).to_numpy(), x[2:5, :4])
    assert evaluate(a["i,j"].block((1, 0), (2, 2), preserve=True), Labels("ij")).trange.elements.lower == (2, 0)
    assert evaluate(cut.at(7, 9), Labels("ij")).trange.elements.lower == (7, 9)
    c = a.clone()
    c["i,j"].block((1, 0), (2, 2)).assign(10 * a["i,j"].block((1, 0), (2, 2)))
    y = x.copy()
    y[2:5, :4] *= 10
    assert np.array_equal(c.to_numpy(), y)
    block = c["i,j"].block((0, 0), (1, 1))
    block -= a["i,j"].block((0, 0), (1, 1))
    y[:2, :3] -= x[:2, :3]
    assert np.array_equal(c.to_numpy(), y)
    with pytest.raises(AnnotationError):
        c["i,j"].block((0, 0), (1, 1)).assign(a["i,j"])


def test_mask_and_block_contraction(spark):
    a, x = make(spark, 1, A, B, policy=DENSE)
    mask = spark.createDataFrame([(0, 1, 1.0)], "t0 int, t1 int, norm double")
    found = evaluate((a["i,k"] * a["j,k"]).set_shape(mask), Labels("ij"))
    want = x @ x.T
    want[2:, :] = 0
    want[:, :2] = 0
    assert np.array_equal(found.to_numpy(), want)


def test_tile_product(spark):
    a, x = make(spark, 1, B, A, Tiling.whole(3), policy=DENSE)
    b, y = make(spark, 2, A, B, policy=DENSE)
    assert np.array_equal(tile_product(a, "i,k,h", b, "k,j", "h,i,j", side=2).to_numpy(), np.einsum("ikh,kj->hij", x, y))


def test_tiles(spark):
    a, x = make(spark, 1, A, B, policy=DENSE)
    a.set_tile((1, 2), 5.0)
    x[2:5, 4:7] = 5
    assert np.array_equal(a.to_numpy(), x) and a.find((1, 2)).count() == 9
    s = from_numpy(spark, np.zeros((5, 7)), TiledRange((A, B)), SPARSE)
    assert s.df.count() == 0 and s.is_zero((0, 0))


def test_pushdown_and_no_aggregate(spark, sf_dir):
    """A block's bounds reach the scan; an elementwise product has no aggregate."""
    from lattica.tensor import from_table

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = from_table(lines, ["l_orderkey", "l_partkey"], "l_quantity", TiledRange.uniform((2000, 200), (100, 50)))
    plan = evaluate(t["i,j"].block((0, 1), (1, 2)), Labels("ij")).df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_partkey,50)" in plan and "LessThan(l_orderkey,100)" in plan
    assert "Aggregate" not in evaluate(t["i,j"] * t["i,j"], Labels("ij")).df._jdf.queryExecution().toString()
