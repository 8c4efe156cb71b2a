"""Star rounds keep to the partitions of their links, so that the driver doesn't hold more tasks than it must."""

from ledgerloom.llm import components


def test_a_round_deals_links_without_more_partitions(spark):
    edges = spark.range(0, 2000, 1, 6).selectExpr("id div 2 as a", "id + 1 as b")
    both = components._each(edges, [edges.a, edges.b], [edges.b, edges.a])
    assert both.rdd.getNumPartitions() == 6
    assert sorted(both.collect()) == sorted(tuple(r) for e in edges.collect() for r in ((e.a, e.b), (e.b, e.a)))
    plan = components._round(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # hot and other keys
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(n, 0) for n in range(1, 2001)}


def _written(monkeypatch):
    """What components() writes, in the order of writing."""
    seen, write = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: seen.append(write(df)) or seen[-1])
    return seen


def test_few_links_in_many_partitions_take_no_round(spark, monkeypatch):
    written = _written(monkeypatch)
    monkeypatch.setattr(components, "_round", lambda *_: 1 / 0)
    edges = spark.range(0, 3000).selectExpr("id as a", "id + 1 as b").repartition(40, "a")
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(n, 0) for n in range(1, 3001)}
    assert [w.rdd.getNumPartitions() for w in written] == [40, 1]


def test_gathered_links_and_rounds_give_whole_components(spark, monkeypatch):
    monkeypatch.setattr(components, "GATHER", 1000)  # three tasks gather, so rounds are left
    written = _written(monkeypatch)
    edges = spark.range(0, 3000).where("id % 500 <> 499").selectExpr("id as a", "id + 1 as b").repartition(40, "a")
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(n, n // 500 * 500) for n in range(3000) if n % 500}
    assert written[1].rdd.getNumPartitions() == 3 and len(written) > 2


def test_links_of_one_star_that_meet_another_are_still_open(spark):
    def state(rows):
        return components._open(spark.createDataFrame(rows, "a long, b long"))

    assert state([(1, 2), (1, 3), (4, 5)]) == (3, False)
    assert state([(1, 3), (2, 3)]) == (2, True)
    assert state([(1, 2), (2, 3)]) == (2, True)
    assert state([(1, 2), (1, 2)]) == (2, False)
    assert state([]) == (0, False)
