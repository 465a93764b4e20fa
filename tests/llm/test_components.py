"""Connected components against a search, and the driver's work for them."""

import random

import pytest

from lingsmith.llm import _spark, jaccard
from lingsmith.llm._spark import components


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [x] if x not in out else []
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return out


def graphs():
    rng = random.Random(3)
    n = 1500
    yield "random", [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    yield "path", [(i, i + 1) for i in rng.sample(range(600), 600)]
    names = rng.sample(range(10**12), 500)
    yield "unordered path", rng.sample(list(zip(names, names[1:])), 499)
    yield "hub", [(5000, i) for i in range(800)] + [(i, i + 10_000) for i in range(800)]
    yield "negative, doubled", [(-3, 7), (7, -3), (7, 2**62), (1, 1), (9, 8), (9, 8)]
    yield "none", []


@pytest.mark.parametrize("name, edges", list(graphs()))
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges, "x long, y long").repartition(7)
    got = [tuple(r) for r in components(spark, df).collect()]
    want = plain([(a, b) for a, b in edges if a != b])
    assert len(got) == len(want) and dict(got) == want


def test_jobs_of_the_driver(spark):
    """Groups that cross tasks, as near-duplicates do: the driver must not make a hundred jobs of them."""
    rng = random.Random(5)
    edges = [(rng.randrange(g * 20, g * 20 + 20), rng.randrange(g * 20, g * 20 + 20)) for g in range(100) for _ in range(40)]
    df = spark.createDataFrame(edges, "x long, y long").repartition(8)
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = {r.id: r.component for r in components(spark, df).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == plain([(a, b) for a, b in edges if a != b])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    assert jobs <= 25


def test_python_workers_of_a_task(spark, monkeypatch):
    """A task takes a Python worker for each mapInArrow in it, and an executor keeps all of them: one is enough."""
    plans = []

    def seen(session, df, write=_spark.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(session, df)

    monkeypatch.setattr(_spark, "staged", seen)
    monkeypatch.setattr(jaccard, "staged", seen)
    rows = [(i, " ".join(f"w{i // 3}x{j + (i % 3) // 2}" for j in range(40))) for i in range(60)]
    got = jaccard.groups(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 3 * 3 for i in range(60)}
    of_task = []
    for plan in plans:
        above = []  # (depth, whether it is a mapInArrow) of a line's parents
        for line in plan.split("\n"):
            depth = len(line) - len(line.lstrip(" :+-*"))
            name = line.lstrip(" :+-*").split(" ")[0].strip("()0123456789")
            above = [x for x in above if x[0] < depth]
            above.append((depth, name))
            if name == "MapInArrow":
                since = max([i for i, x in enumerate(above) if "Exchange" in x[1]], default=-1)
                of_task.append(sum(x[1] == "MapInArrow" for x in above[since + 1 :]))
    assert len(of_task) >= 15 and max(of_task) == 1
