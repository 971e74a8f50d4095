"""Hierarchies against a walk in plain Python."""

import random

from heddle.operators import hierarchy as H


def walk(parents):
    out = {}
    for n in set(parents) | set(parents.values()):
        path, seen = [n], {n}
        while path[-1] in parents:
            up = parents[path[-1]]
            if up in seen:
                path = None
                break
            path.append(up)
            seen.add(up)
        out[n] = (None, -1, True, None) if path is None else (path[-1], len(path) - 1, False, path[::-1])
    return out


def solve(spark, parents, rate=4):
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    return {r["node"]: (r["root"], r["depth"], r["is_cycle"], r["path"]) for r in H.resolve(df, rate=rate, with_paths=True).collect()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    parents = {f"n{i}": f"n{rng.randrange(max(0, i - 3), i + 1)}" for i in range(1, 60)}
    parents |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"below": "c2", "below2": "below", "self": "self"}
    assert solve(spark, parents) == walk(parents)


def test_long_chain_and_loops_without_splitter(spark):
    chain = {f"k{i}": f"k{i + 1}" for i in range(300)}
    loops = {f"l{j}_{i}": f"l{j}_{(i + 1) % 3}" for j in range(4) for i in range(3)}
    tail = {f"t{i}": f"t{i - 1}" if i else "l0_0" for i in range(20)}
    assert solve(spark, chain | loops | tail, rate=7) == walk(chain | loops | tail)


def test_nulls_empty_and_extra_nodes(spark):
    empty = spark.createDataFrame([], "node string, parent string")
    assert H.resolve(empty).count() == 0
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "d")], "node string, parent string")
    alone = spark.createDataFrame([("z",), (None,)], "node string")
    assert {r["node"]: r["depth"] for r in H.resolve(df, alone).collect()} == {"c": 1, "d": 0, "z": 0}


def test_latest_parent_and_ties(spark):
    rows = [("a", "p", 1), ("a", "q", 2), ("b", "p", 5), ("b", "q", 5), ("c", "p", None), (None, "p", 1), ("d", None, 1), ("a", "q", 2)]
    df = spark.createDataFrame(rows, "child string, parent string, at int")
    assert {tuple(r) for r in H.latest_parent(df, "child", "parent", "at").collect()} == {("a", "q"), ("b", "q"), ("c", "p")}


def test_descendants(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "node string, parent string")
    rows = H.descendants(H.resolve(df, with_paths=True))
    assert {tuple(r) for r in rows.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_descendants_query_names_them(spark):
    import __spark_entry__ as E

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in E.queries()["p5_descendants"](spark, d).select("tree", "node_key", "descendant_key", "distance").collect()]
    paths = [(r["tree"], r["path"].split("/")) for r in E.queries()["p5_paths"](spark, d).collect()]
    assert rows and sorted(rows) == sorted((t, p[i], p[-1], len(p) - 1 - i) for t, p in paths for i in range(len(p) - 1))
    counts = {(r["tree"], r["node_key"]): r["descendants"] for r in E.queries()["p5_descendant_counts"](spark, d).collect()}
    assert sum(counts.values()) == len(rows)
