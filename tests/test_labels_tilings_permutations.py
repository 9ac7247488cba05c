import pytest

from lattica import labels as L
from lattica.perm import Group, Irrep, NestedPermutation, Permutation, Representation
from lattica.tiling import Range, TiledRange, Tiling


def test_annotations():
    assert L.parse("i, j;m") == (L.Labels("ij"), L.Labels("m"))
    assert L.parse("left,right") == (L.Labels(["left", "right"]), L.Labels())
    for bad in ("i,,j", "i;j;k", "i,i", "i;", "i;i", ",i"):
        with pytest.raises(L.AnnotationError):
            L.parse(bad)
    assert L.dummy(2, 1) == "i0,i1;n0"


def test_einsum_strings():
    assert L.parse_einsum("ij;mn,jk;n->ik;m") == (["i,j;m,n", "j,k;n"], "i,k;m")
    assert L.parse_einsum("ij,jk") == (["i,j", "j,k"], None)


def test_label_algebra():
    a, b = L.Labels("ijk"), L.Labels("kl")
    assert (a & b, a | b, a - b, a ^ b) == (L.Labels("k"), L.Labels("ijkl"), L.Labels("ij"), L.Labels("ijl"))
    assert L.Labels("ba").sorted() == L.Labels("ab") and not L.Labels("aa").unique()
    assert a.permutation_to(L.Labels("kij")) == (2, 0, 1)


@pytest.mark.parametrize(
    "a, b, target, kind",
    [("ij", "ji", "ij", L.HADAMARD), ("ij", "jk", "ik", L.CONTRACTION), ("bij", "bjk", "bik", L.GENERAL), ("ij", "ij", "i", L.GENERAL), ("bi", "bk", "bik", L.GENERAL), ("", "ij", "ij", L.SCALE), ("ij", "jk", "i", L.INVALID), ("ij", "jk", "ikz", L.INVALID)],
)
def test_product_classes(a, b, target, kind):
    assert L.product_class(L.Labels(a), L.Labels(b), L.Labels(target)) == kind


@pytest.mark.parametrize(
    "extent, target, marks",
    [((10, 65), 10, (10, 20, 29, 38, 47, 56, 65)), ((10, 69), 10, (10, 20, 30, 40, 50, 60, 69)), (55, 10, (0, 10, 19, 28, 37, 46, 55)), (50, 30, (0, 25, 50)), (0, 5, ())],
)
def test_uniform_tilings(extent, target, marks):
    assert Tiling.uniform(extent, target).marks == marks


def test_tilings():
    t = Tiling((0, 2, 5, 10, 17, 28))
    assert [t.tile_of(i) for i in (0, 1, 2, 16, 27)] == [0, 0, 1, 3, 4]
    assert Tiling((1, 3, 7, 9)).concat(Tiling((0, 3, 4, 5))).marks == (1, 3, 7, 9, 12, 13, 14)
    assert t.shift(3).congruent(t) and t.block(1, 3).marks == (2, 5, 10)
    for bad in (28, -1):
        with pytest.raises(IndexError):
            t.tile_of(bad)
    with pytest.raises(ValueError):
        Tiling((0, 2, 2))


def test_tile_columns(spark):
    from pyspark.sql import functions as F

    for t in (Tiling((0, 2, 5, 10, 17, 28)), Tiling.uniform((10, 65), 10), Tiling.uniform(60, 10), Tiling.whole(7)):
        rows = spark.range(t.lower, t.upper).select("id", t.tile_column(F.col("id")).alias("t")).select("id", "t", t.size_column(F.col("t")).alias("n")).collect()
        assert all(r.t == t.tile_of(r.id) and r.n == t.sizes()[r.t] for r in rows)


def test_ranges():
    r = Range((1, 2), (4, 6))
    assert r.volume == 12 and [r.ordinal(i) for i in r] == list(range(12)) and r.index(5) == (2, 3)
    assert r.shift((1, 1)).congruent(r) and r.permute((1, 0)) == Range((2, 1), (6, 4))
    assert r.overlap(Range((3, 0), (9, 3))) == Range((3, 2), (4, 3)) and r.overlap(Range((4, 2), (5, 3))) is None
    t = TiledRange.uniform((5, 7), 3)
    assert t.tiles.extents == (2, 3) and t.tile_of((4, 6)) == (1, 2) and t.tile_range((1, 2)) == Range((3, 5), (5, 7))


def test_permutations():
    p, q = Permutation((1, 2, 0)), Permutation.from_cycles(3, (0, 1))
    assert (p * p.inverse()).is_identity() and p**3 == Permutation.identity(3) and p**-1 == p.inverse()
    assert p.apply("abc") == ("c", "a", "b") and p.cycles() == [(0, 1, 2)] and q.parity() == -1
    assert (NestedPermutation(p, q) * NestedPermutation(p, q).inverse()).outer.is_identity()
    with pytest.raises(ValueError):
        Permutation((0, 0))


def test_groups():
    s3 = Group.symmetric(3)
    assert s3.order == 6 and s3.is_symmetric() and s3.smallest((3, 1, 2)) == (1, 2, 3)
    assert s3.stabilizer([0]).order == 2 and s3.domain() == {0, 1, 2}
    cyclic = Group([Permutation((1, 2, 0))])
    assert cyclic.order == 3 and s3.intersect(cyclic) == cyclic and cyclic.conjugate(Permutation((1, 0, 2))) == cyclic
    assert sum(Representation.antisymmetric(3).factors.values()) == 0
    assert Irrep((2, 1)).dimension() == 2 and Irrep((3, 1)).dimension() == 3
    with pytest.raises(ValueError):
        Representation({Permutation((1, 2, 0)): -1})
