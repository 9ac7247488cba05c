"""Queries against their SQL over tables whose extents and supports the given ones don't have."""

import duckdb
import numpy as np
import pytest

from lattica import catalogue
from lattica.labels import Labels
from lattica.operators import reduce as R
from lattica.operators import shape
from lattica.plans import blocks
from lattica.tensor import Tensor
from lattica.tiling import TiledRange, Tiling


def agree(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.sql(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (sorted(map(tuple, x[columns].astype(float).to_numpy().tolist())) for x in (got, want))
    assert got == want


def vectors(spark, folder, n):
    x = np.random.default_rng(7).integers(-900, 900, (n, 64)) / 1000 + 0.0004
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("n", [130, 250, 256])
def test_foreach_tiles_of_vectors_that_fill_no_whole_tiles(spark, tmp_path, n):
    vectors(spark, tmp_path, n)
    agree(spark, tmp_path, "foreach_tiles", "embeddings")


def lines(spark, folder, rows, suppliers, parts):
    """lineitem of (supplier, part, quantity), and the keys' tables."""
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(suppliers).withColumnRenamed("id", "s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(parts).withColumnRenamed("id", "p_partkey").write.parquet(f"{folder}/part.parquet")


def test_shape_add_constant_leaves_tiles_out_that_are_not_stored(spark, tmp_path):
    lines(spark, tmp_path, [(0, 0, 5.0), (4, 99, 7.0), (5, 150, 2.0), (14, 299, 3.0)], 15, 300)
    agree(spark, tmp_path, "shape_add_constant", "lineitem", "supplier", "part")


def test_product_small_beyond_a_double(spark, tmp_path):
    events = spark.range(300_000).selectExpr("id % 300 AS user_id", "concat('e', id % 2) AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert float(catalogue.QUERIES["product_small"](spark, str(tmp_path)).collect()[0].value) == round(300 * np.log(2.0), 6)
    events.where("user_id < 0").unionByName(spark.range(3_000_000).selectExpr("id % 3000 AS user_id", "'e' AS event_type")).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    agree(spark, tmp_path, "product_small", "events")  # 2 ** 3000


def test_log_product_of_zeros_signs_holes_and_nothing(spark):
    trange = TiledRange.uniform((4,), 2)
    t = lambda rows: Tensor(spark.createDataFrame(rows, "i0 bigint, v double"), trange)
    value = lambda x: R.reduction("log_product", x["i"]).collect()[0].value
    assert value(t([(0, -2.0), (1, 3.0)])) == pytest.approx(np.log(6)) and value(t([])) == 0
    assert value(t([(0, 0.0), (1, 3.0)])) == value(t([(1, 3.0)])) == -np.inf


def above_the_join(frame):
    """The plan from the result down to the first join."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join")]


def test_gram_embeddings_deals_out_no_pairs_of_tiles(spark, tmp_path):
    vectors(spark, tmp_path, 300)
    agree(spark, tmp_path, "gram_embeddings", "embeddings")
    above = above_the_join(catalogue.QUERIES["gram_embeddings"](spark, str(tmp_path)))
    assert "MapInArrow" in above and "FlatMapGroups" not in above


def test_gram_embeddings_elements_by_tiles_deals_out_no_pairs_of_tiles(spark, tmp_path):
    vectors(spark, tmp_path, 900)  # enough multiplications for tiles
    found = catalogue.QUERIES["gram_embeddings_elements"](spark, str(tmp_path))
    above = above_the_join(found)
    assert "MapInArrow" in above and "FlatMapGroups" not in above
    x = np.zeros((900, 64))
    for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect():
        x[r.vec_id] = np.floor(np.array(r.embedding) * 1000)
    got = found.toPandas()
    assert len(got) == 900 * 900 and np.array_equal(np.sort(got["n"] * 900 + got["m"]), np.arange(900 * 900))
    assert np.array_equal((x @ x.T)[got["n"], got["m"]], got["v"])


def test_shape_gemm_joins_no_tiles_one_by_one(spark, tmp_path):
    """What is joined on the contracted label is blocks of tiles: no more rows than blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(s) + 50 * c, int(p) + 1000 * c, float(v)) for c in range(8) for s, p, v in zip(rng.integers(0, 50, 400), rng.integers(0, 1000, 400), rng.integers(1, 50, 400))]
    lines(spark, tmp_path, rows, 400, 8000)
    agree(spark, tmp_path, "shape_gemm", "lineitem", "supplier", "part")
    above = above_the_join(catalogue.QUERIES["shape_gemm"](spark, str(tmp_path)))
    assert "MapInArrow" in above and "sum(" not in above


def test_shape_gemm_without_the_second_range(spark):
    a, b = (spark.createDataFrame(r, "t0 int, t1 int, norm double") for r in ([(0, 0, 1.0), (1, 299, 2.0), (299, 1, 4.0)], [(5, 0, 3.0), (260, 299, 5.0), (7, 8, 1.0)]))
    found = shape.gemm(a, Labels("ik"), TiledRange.uniform((300, 300), 1), b, Labels("jk"), Labels("ij"))
    assert sorted(map(tuple, found.collect())) == [(0, 5, 3.0), (1, 260, 10.0)]


def far_apart(spark, folder, n, apart):
    vectors(spark, folder / "near", n)
    spark.read.parquet(f"{folder}/near/embeddings.parquet").selectExpr(f"vec_id * {apart} AS vec_id", "embedding").write.parquet(f"{folder}/embeddings.parquet")


def test_gram_embeddings_elements_by_tiles_of_ids_far_apart(spark, tmp_path):
    far_apart(spark, tmp_path, 900, 1_000_003)
    above = above_the_join(catalogue.QUERIES["gram_embeddings_elements"](spark, str(tmp_path)))
    assert "MapInArrow" in above and "FlatMapGroups" not in above and "sum(" not in above
    agree(spark, tmp_path, "gram_embeddings_elements", "embeddings")


def test_gram_embeddings_has_no_rows_of_ids_that_are_not_there(spark, tmp_path):
    far_apart(spark, tmp_path, 90, 3)
    agree(spark, tmp_path, "gram_embeddings", "embeddings")


@pytest.mark.parametrize("buckets", [None, {"i": 2, "k": 3}])
def test_tiles_with_holes_are_added_up_over_the_contracted_label(spark, buckets):
    rng = np.random.default_rng(2)
    tables = [{(int(i), int(k)): float(v) for i, k, v in zip(rng.integers(0, n, 120), rng.integers(0, 50, 120), rng.integers(-9, 9, 120))} for n in (40, 30)]
    a, b = (Tensor(spark.createDataFrame([(i, k, v) for (i, k), v in t.items()], "i0 bigint, i1 bigint, v double"), TiledRange.uniform((n, 50), 10)) for t, n in zip(tables, (40, 30)))
    want = {}
    for (i, k), v in tables[0].items():
        for (j, m), w in tables[1].items():
            if k == m:
                want[i, j] = want.get((i, j), 0.0) + v * w
    got = blocks.tile_product(a, "i,k", b, "j,k", "i,j", 8, buckets).df.collect()
    assert len(got) == len(want) and {(r.i0, r.i1): r.v for r in got} == want


def test_shape_add_constant_has_every_tile_of_the_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shape, "RUN_TILES", 7)
    lines(spark, tmp_path, [(0, 0, 5.0), (4, 99, 7.0), (5, 150, 2.0), (39, 699, 3.0), (39, 0, 4.0)], 40, 700)
    agree(spark, tmp_path, "shape_add_constant", "lineitem", "supplier", "part")
    found = {(r.t0, r.t1): r.norm for r in catalogue.QUERIES["shape_add_constant"](spark, str(tmp_path)).collect()}
    assert set(found) == {(i, j) for i in range(8) for j in range(7)} and found[7, 5] == 0.0894 and found[7, 6] == 0.0954


def test_a_constant_is_added_to_tiles_of_unlike_sizes(spark):
    trange = TiledRange((Tiling((0, 2, 5, 10)), Tiling((3, 4, 10))))
    a = spark.createDataFrame([(0, 1, 1.0), (2, 0, float("nan")), (3, 0, 1.0), (0, 2, 1.0)], "t0 int, t1 int, norm double")  # the last two are not of the range
    found = {(r.t0, r.t1): r.norm for r in shape.add_constant(a, trange, -3.0).collect()}
    sizes = {(i, j): m * n for i, m in enumerate((2, 3, 5)) for j, n in enumerate((1, 6))}
    assert np.isnan(found.pop((2, 0))) and len(found) == 5
    assert all(v == pytest.approx((t == (0, 1)) + 3 / np.sqrt(sizes[t])) for t, v in found.items())
    assert shape.add_constant(a.where("t0 < 2"), trange, 1e-9).count() == 1


@pytest.mark.parametrize("buckets", [None, {"i": 2, "k": 3}])
def test_whole_tiles_of_a_large_result_are_added_up_in_one_task(spark, buckets):
    """No parts of the result's tiles are dealt out, only the factors."""
    rng = np.random.default_rng(5)
    x, y = (rng.integers(-9, 9, (n, 50)) * (rng.random((n, 50)) < 0.2) for n in (70, 60))
    a, b = (Tensor(spark.createDataFrame([(int(i), int(k), float(m[i, k])) for i, k in zip(*np.nonzero(m))], "i0 bigint, i1 bigint, v double"), TiledRange.uniform(m.shape, 10)) for m in (x, y))
    found = blocks.tile_product(a, "i,k", b, "j,k", "i,j", 8, buckets).df
    above = above_the_join(found)
    assert "MapInArrow" in above and "FlatMapGroups" not in above
    got, want, stored = {(r.i0, r.i1): r.v for r in found.collect()}, x @ y.T, (x != 0).astype(int) @ (y != 0).T > 0
    assert found.count() == len(got) == stored.sum() and all(stored[t] and want[t] == v for t, v in got.items())


def test_shape_gemm_deals_out_no_parts_of_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shape, "GEMM_TILES", 16)
    rng = np.random.default_rng(3)
    lines(spark, tmp_path, [(int(s), int(p), float(v)) for s, p, v in zip(rng.integers(0, 200, 900), rng.integers(0, 4000, 900), rng.integers(1, 50, 900))], 200, 4000)
    agree(spark, tmp_path, "shape_gemm", "lineitem", "supplier", "part")
    assert "FlatMapGroups" not in above_the_join(catalogue.QUERIES["shape_gemm"](spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["gram_embeddings", "gram_embeddings_elements"])
def test_vectors_times_themselves_are_dealt_out_once(spark, tmp_path, name):
    vectors(spark, tmp_path, 900)
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    assert len(found.collect()) == 900 * 900
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" in plan or "NestedLoop" in plan
    assert "ReusedExchange" in plan


def test_wide_vectors_are_added_up_whole(spark, tmp_path):
    x = np.random.default_rng(9).integers(-900, 900, (300, 300)) / 1000 + 0.0004
    spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["gram_embeddings"](spark, str(tmp_path))
    assert "FlatMapGroups" not in above_the_join(found)
    got, y = found.toPandas(), np.floor(x.astype(np.float32).astype(float) * 1000)
    assert len(got) == 90000 and np.array_equal((y @ y.T)[got["n"], got["m"]], got["v"])
