"""Small tables between the rounds of clustering do not keep, or add up, the shuffle partitions they came from."""

import pytest

from pulsegrid.llm.candidates import Clusters
from pulsegrid.llm.components import components


@pytest.fixture
def few(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 4 * spark.sparkContext.defaultParallelism
    for k, v in before.items():
        spark.conf.set(k, v)


def test_links_of_a_look_stay_in_few_partitions(spark, few):
    facts = spark.createDataFrame([(i, 10, bytes([1 + i // 10] * 4)) for i in range(30)], "rid long, n long, sketch binary")
    found = Clusters(facts, lambda n, m, x, y: (x == y).all(axis=1), 100)
    nodes = spark.createDataFrame([(i % 10 % 3, i) for i in range(30)] + [(50 + i, i) for i in range(30)], "node long, rid long")  # the last are alone
    assert found.look(nodes, last=True) is None
    assert found.links.rdd.getNumPartitions() <= few and found.labels.rdd.getNumPartitions() <= few
    assert {r.id: r.root for r in components(found.links).collect()} == {i: i // 10 * 10 + i % 10 % 3 for i in range(30)}


def test_components_of_few_links_in_few_partitions(spark, few):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (100, 200), (200, 300), (7, 7)], "a long, b long")
    out = components(edges)
    assert out.rdd.getNumPartitions() <= few
    assert {r.id: r.root for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 100: 100, 200: 100, 300: 100}
