"""Order of tasks and its violations against plain Python versions of the reference's rules."""

import random

from statuta.operators import process as K


def breadth_first(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    queue, seen = ["s"], []
    while queue:
        node = queue.pop(0)
        if node not in seen:
            seen.append(node)
            queue += after.get(node, [])
    return seen


def test_task_order(spark):
    rng = random.Random(3)
    chosen = {0: [("s", "t2"), ("s", "t1"), ("t1", "t9"), ("t2", "t10"), ("t10", "s")]}
    for p in range(1, 12):
        nodes = ["s", *[f"t{k}" for k in range(1, 25)]]
        chosen[p] = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("s", "t20"), ("s", "t3")]
    edges = spark.createDataFrame([(p, k, a, b) for p, es in chosen.items() for k, (a, b) in enumerate(es)], "process_id int, pos int, source string, target string")
    tasks = spark.createDataFrame([(p, f"t{k}", f"name {k}") for p in chosen for k in range(1, 25)], "process_id int, node_id string, name string")
    starts = spark.createDataFrame([(p, "s") for p in chosen], "process_id int, node_id string")
    got = {}
    for r in sorted(K.task_order(starts, edges, tasks).collect(), key=lambda r: r.place):
        got.setdefault(r.process_id, []).append(r.node_id)
    assert got == {p: [n for n in breadth_first(es) if n != "s"] for p, es in chosen.items()}
    assert got[0] == ["t2", "t1", "t10", "t9"]


def test_large_and_small_processes_are_ordered_alike(spark):
    rng = random.Random(5)
    nodes = ["s", *[f"t{k}" for k in range(1, 15)]]
    rows = [(p, rng.randrange(4), rng.choice(nodes), rng.choice([*nodes, None])) for p in range(40) for _ in range(rng.randrange(1, 40))] + [(None, 1, "s", "t1"), (41, 1, "t1", "t2"), (3, None, "s", "t9")]
    edges = spark.createDataFrame(rows, "process_id int, pos int, source string, target string")
    tasks = spark.createDataFrame([(p, n, f"name {n}") for p in [*range(43), None] for n in [*nodes[1:], None]], "process_id int, node_id string, name string")
    starts = spark.createDataFrame([(p, n) for p in [*range(42), None] for n in ("s", "s", "t3")[: 2 + (p or 0) % 2]], "process_id int, node_id string")
    want = sorted(K.task_order(starts, edges, tasks, whole=0).collect())
    assert len(want) > 200 and all(sorted(K.task_order(starts, edges, tasks, whole=w).collect()) == want for w in (20, 1000))


def test_small_processes_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(K, "depths", None)
    edges = spark.createDataFrame([(1, 1, "s", "t1"), (1, 2, "t1", "t2")], "process_id int, pos int, source string, target string")
    tasks = spark.createDataFrame([(1, "t2", "b"), (1, "t1", "a"), (1, "t3", "c")], "process_id int, node_id string, name string")
    starts = spark.createDataFrame([(1, "s")], "process_id int, node_id string")
    assert sorted(K.task_order(starts, edges, tasks).collect()) == [(1, "t1", "a", 1), (1, "t2", "b", 2)]


def test_out_of_order(spark):
    ordered = spark.createDataFrame([(p, n, k + 1) for p in (1, 2) for k, n in enumerate(["Notify the subject", "Record the decision", None][: 4 - p])] + [(3, "record notify", 1)], "process_id int, name string, place int")
    rules = [
        (1, 1, "record the decision", "Record before notify"),
        (2, 1, "erase all data", "record before notify"),
        (3, 1, "record the decision", "record before-notify notify"),
        (4, 2, "record decision", "Before all, record BEFORE notify us"),
        (5, 2, "record decision", "notify before record"),
        (6, 2, "record decision", "record before notify."),
        (7, 2, "record decision", "before record before"),
        (8, 3, "record notify", "record before notify"),
        (9, 1, None, "record before notify"),
        (10, 2, None, "record before notify"),
        (11, 2, "record decision", "before notify"),
        (12, 2, "record decision", None),
    ]
    got = K.out_of_order(spark.createDataFrame(rules, "rule_id int, process_id int, action string, text string"), ordered).collect()
    assert sorted(r.rule_id for r in got) == [1, 4, 9]


def test_long_chains_are_ordered(spark):
    steps = [(1, k, f"n{k}", f"n{k + 1}") for k in range(45)] + [(1, 50, "n44", "n3"), (2, 0, "n0", "n1")]
    edges = spark.createDataFrame(steps, "process_id int, pos int, source string, target string")
    starts = spark.createDataFrame([(1, "n0"), (2, "n0"), (3, "n0")], "process_id int, node_id string")
    got = {(r.process_id, r.node_id): r.depth for r in K.depths(starts, edges, compact=10).collect()}
    assert got == {(1, f"n{k}"): k for k in range(46)} | {(2, "n0"): 0, (2, "n1"): 1, (3, "n0"): 0}
