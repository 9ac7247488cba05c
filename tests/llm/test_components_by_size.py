"""Components by one task and by rounds of shuffles: the same result, at a different cost to the driver."""

import numpy as np
import pytest

from lattica.llm import components as C


def wanted(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and root[u] != root[v]:
                root[u] = root[v] = min(root[u], root[v])
                changed = True
    return root


def graph():
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))]  # components of all sizes, loops
    edges += [(1000, 2000 + k) for k in range(60)] + [(9000, 1000 - k) for k in range(1, 40)]  # hubs, one of which is its component's largest node
    edges += [(-(2**62) + k, -(2**62) + k + 1) for k in range(50)] + [(2**63 - 1, -(2**63))]  # a path, the ends of a bigint
    return edges + edges[:30] + [(v, u) for u, v in edges[:30]]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(C, "TASK_EDGES", most)
    monkeypatch.setattr(C, "HUB_EDGES", 10)
    rows = C.components(spark.createDataFrame(graph(), "u bigint, v bigint").repartition(3)).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.root for r in rows} == wanted(graph())
    assert C.components(spark.createDataFrame([(7, 7)], "u bigint, v bigint")).collect() == []


def test_few_edges_cost_few_jobs(spark):
    spark.sparkContext.setJobGroup("components", "")
    C.components(spark.createDataFrame(graph(), "u bigint, v bigint"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 8
