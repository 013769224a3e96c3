"""Joins that make many pairs, against brute force: dealt out in small cells, with the same rows."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.federation import Federation
from tessera.operators import pairs
from tessera.sources.table import from_context

EX = "http://e.x/"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS", 400)
    monkeypatch.setattr(pairs, "LARGE", 0)


def graph(spark, a, b, schema="id bigint, v double"):
    fed = Federation(spark)
    for name, rows in (("a", a), ("b", b)):
        ctx = {"@context": {"@type": f"{EX}{name}", "@uriProperty": "id", "id": f"{EX}{name}id", "v": f"{EX}{name}"}, "@instancePrefix": f"{EX}{name}/"}
        fed.add_source(from_context(spark.createDataFrame(list(enumerate(rows)), schema), ctx, name))
    return fed


def asked(fed, condition):
    return fed.query(f"PREFIX : <{EX}> SELECT ?i ?j WHERE {{ ?x :aid ?i ; :a ?p . ?y :bid ?j ; :b ?q FILTER({condition}) }}")


def sizes(df):
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


VALUES = random.Random(5)
LEFT = [VALUES.uniform(-100, 100) for _ in range(150)] + [3.0] * 60 + [None, NAN, INF, -INF, 0.0, -0.0]
RIGHT = [VALUES.uniform(-90, 140) for _ in range(200)] + [3.0] * 80 + [100.0] * 30 + [None, NAN, INF, -INF, -0.0]


def spark_order(x):
    return (1, 0) if math.isnan(x) else (0, x)


@pytest.mark.parametrize("condition, test", [
    ("?p < ?q", lambda p, q: p < q), ("?p <= ?q", lambda p, q: p <= q), ("?p > ?q", lambda p, q: p > q), ("?q >= ?p", lambda p, q: q >= p), ("?q < ?p", lambda p, q: q < p),
])
def test_comparisons_keep_all_pairs(spark, condition, test):
    got = Counter(map(tuple, asked(graph(spark, LEFT, RIGHT), condition).collect()))
    want = Counter((i, j) for i, p in enumerate(LEFT) for j, q in enumerate(RIGHT) if p is not None and q is not None and test(spark_order(p), spark_order(q)))
    assert got == want


def test_comparison_is_dealt_out_and_compares_little_else(spark):
    a, b = [float(i) for i in range(300)], [float(i) for i in range(300)]
    df = asked(graph(spark, a, b), "?p < ?q - 100")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.count() == sum(p < q - 100 for p in a for q in b) and max(sizes(df)) < 8 * pairs.PAIRS


def test_times_and_nothing_to_compare(spark):
    start = datetime(2024, 1, 1)
    a, b = [start + timedelta(hours=i) for i in range(60)], [start + timedelta(hours=2 * i) for i in range(50)]
    got = asked(graph(spark, a, b, "id bigint, v timestamp"), "?p > ?q").count()
    assert got == sum(p > q for p in a for q in b)
    assert asked(graph(spark, [None] * 50, RIGHT), "?p < ?q").count() == 0


def test_one_value_is_dealt_over_several_cells(spark):
    df = asked(graph(spark, [1.0] * 200, [2.0] * 300), "?p < ?q")
    assert df.count() == 60000 and max(sizes(df)) < 60000 / 8


def test_frequent_keys_are_dealt_out(spark):
    """?p and ?q are the keys here; one of them has most pairs, others few or none."""
    a, b = [1.0] * 200 + [2.0] * 3 + [4.0, None], [1.0] * 150 + [2.0] * 70 + [3.0, None]
    df = graph(spark, a, b).query(f"PREFIX : <{EX}> SELECT ?i ?j WHERE {{ ?x :aid ?i ; :a ?p . ?y :bid ?j ; :b ?p }}")
    assert Counter(map(tuple, df.collect())) == Counter((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p is not None and p == q)
    assert max(sizes(df)) < 12 * pairs.PAIRS


def test_many_pairs_of_rare_keys(spark):
    a, b = [float(i % 40) for i in range(400)], [float(i % 50) for i in range(500)]
    df = graph(spark, a, b).query(f"PREFIX : <{EX}> SELECT ?i ?j WHERE {{ ?x :aid ?i ; :a ?p . ?y :bid ?j ; :b ?p }}")
    assert Counter(map(tuple, df.collect())) == Counter((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p == q)


def test_products_are_dealt_out(spark):
    a, b = [float(i) for i in range(100)], [float(i) for i in range(90)]
    df = asked(graph(spark, a, b), "?p != ?q")
    assert df.count() == 100 * 90 - 90 and max(sizes(df)) < 9000 / 4


def test_unique_keys_are_joined_as_they_are(spark):
    df = graph(spark, [1.0] * 50, [2.0] * 50).query(f"PREFIX : <{EX}> SELECT ?p WHERE {{ ?x :a ?p . ?y :bid ?j ; :b ?q FILTER(?p < ?q) }}")
    assert df.count() == 2500
    fed = graph(spark, [1.0] * 50, [2.0] * 50)
    assert fed.query(f"PREFIX : <{EX}> SELECT ?p WHERE {{ ?x :a ?p ; :aid ?i }}").count() == 50
    compiled = fed.compile(fed.plan(f"PREFIX : <{EX}> SELECT ?x ?p WHERE {{ ?x :a ?p }}"))
    assert compiled.df.count() == 50


def test_a_table_with_itself(spark):
    a = [float(i % 7) for i in range(150)]
    fed = graph(spark, a, [])
    same = fed.query(f"PREFIX : <{EX}> SELECT ?i ?j WHERE {{ ?x :aid ?i ; :a ?p . ?y :aid ?j ; :a ?p }}")
    assert Counter(map(tuple, same.collect())) == Counter((i, j) for i, p in enumerate(a) for j, q in enumerate(a) if p == q)
    less = fed.query(f"PREFIX : <{EX}> SELECT ?i ?j WHERE {{ ?x :aid ?i ; :a ?p . ?y :aid ?j ; :a ?q FILTER(?p < ?q) }}")
    assert Counter(map(tuple, less.collect())) == Counter((i, j) for i, p in enumerate(a) for j, q in enumerate(a) if p < q)
