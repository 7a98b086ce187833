"""Levels of detail against brute force, and pages of bounded size."""

import json
import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import levels
from loomgraph.plans import render

ELEMENTS = "id string, kind string, name string, label string, parent string"
EDGES = "src string, dst string, rel string, key string"


def brute(parents, edges):
    def path(x):
        above = parents.get(x)
        return [*(path(above) if above in parents else []), x]

    shown = Counter()
    for a, b, rel in edges:
        p, q = path(a), path(b)
        k = 0
        while k < min(len(p), len(q)) and p[k] == q[k]:
            k += 1
        if a == b:
            k = len(p) - 1
        shown[(p[k - 1] if k else None, p[k] if k < len(p) else a, q[k] if k < len(q) else b, rel)] += 1
    inside = Counter(c for x in parents for c in path(x)[:-1])
    return shown, inside


@pytest.fixture(scope="module")
def nested(spark):
    rng = random.Random(4)
    parents = {f"p{i}": None for i in range(6)}
    # one package holds a third of all nodes, some leaves lie in packages, some nowhere, and one below what is not there
    parents |= {f"n{i}": "p0" if i % 3 == 0 else f"p{rng.randrange(6)}" for i in range(60)}
    parents |= {f"t{i}": rng.choice([f"n{rng.randrange(60)}", f"p{rng.randrange(6)}", None]) for i in range(150)} | {"lost": "gone"}
    names = sorted(parents)
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["calls", "publishes"])) for _ in range(2500)]
    edges += [("p1", "p1", "calls"), ("t1", "t1", "calls"), ("n0", "p0", "calls")] + [(x, p, "calls") for x, p in parents.items() if p in parents] * 2
    elements = spark.createDataFrame([(x, {"p": "Package", "n": "Node"}.get(x[0], "Topic"), x, x, p) for x, p in parents.items()], ELEMENTS)
    return parents, edges, elements, spark.createDataFrame([(a, b, r, r) for a, b, r in edges], EDGES)


def test_levels(nested):
    parents, edges, elements, table = nested
    shown, inside = brute(parents, edges)
    got = {(r["container"], r["src"], r["dst"], r["rel"]): r["n"] for r in levels.level_edges(elements, table).collect()}
    assert got == shown and sum(got.values()) == len(edges)
    rows = {r["id"]: r for r in levels.level_elements(elements).collect()}
    assert {x: r["inside"] for x, r in rows.items()} == {x: inside[x] for x in parents}
    assert {x: r["container"] for x, r in rows.items()} == {x: p if p in parents else None for x, p in parents.items()}


def test_unknown_ends_and_empty(spark, nested):
    _, _, elements, table = nested
    strange = spark.createDataFrame([("p1", "nobody", "calls", "calls"), ("p1", None, "calls", "calls")], EDGES)
    assert levels.level_edges(elements, strange).count() == 0
    assert levels.level_elements(elements.limit(0)).count() == 0 and levels.level_edges(elements.limit(0), table).count() == 0


@pytest.mark.parametrize("crowded", [10, 100_000])
def test_pages(nested, crowded):
    _, _, elements, table = nested
    one, two = levels.level_elements(elements), levels.level_edges(elements, table)
    rows = levels.pages(one, two, 7, crowded).collect()
    sizes = Counter((r["container"], r["part"], r["page"]) for r in rows)
    assert max(sizes.values()) <= 7
    assert len(rows) == one.count() + two.count() and {json.loads(r["line"])["id"] for r in rows if r["part"] == "elements"} == set(nested[0])
    for (container, part, number), n in sizes.items():
        assert n == 7 or (container, part, number + 1) not in sizes


def embedded(lines):
    text = "".join(lines)
    return json.loads(text.partition("id='graph'>")[2].partition("</script>")[0])


@pytest.fixture(scope="module")
def small(spark):
    """A model of two packages, with what the page reads of it."""
    vertices = spark.createDataFrame(
        [("pkg:a", "Package", "a", "a"), ("pkg:b", "Package", "b", "b"), ("topic:/x</script>", "Topic", "/x</script>", None)]
        + [(f"node:a/n{i}", "Node", f"n{i}", "a") for i in range(12)],
        "id string, kind string, name string, package string",
    )
    comm = spark.createDataFrame([(f"node:a/n{i}", "topic:/x</script>", "publishes" if i == 3 else "subscribes", "k", i) for i in range(12)], EDGES + ", seq bigint")
    deps = spark.createDataFrame([("pkg:a", "pkg:b", "depends_on", "depends_on"), ("node:a/n1", "pkg:a", "defined_in", "defined_in")], EDGES)
    return SimpleNamespace(vertices=vertices, comm_edges=comm, edges=deps.unionByName(comm.drop("seq")), packages=vertices)


def test_page_whole(small):
    lines = list(render.page(small, "<ws>"))
    got = embedded(lines)
    assert "<h1>&lt;ws&gt;</h1>" in lines[0] and r".join('\n')" in lines[-1]
    assert got["summary"] == {"Package": 2, "Node": 12, "Topic": 1, "Service": 0, "Action": 0, "Interface": 0}
    assert list(got["views"]) == ["deps", "comms", "full"] and all(v["whole"] for v in got["views"].values())
    assert {e["id"] for e in got["views"]["deps"]["elements"]} == {"pkg:a", "pkg:b"} and len(got["views"]["deps"]["edges"]) == 1
    full = {e["id"]: e.get("container") for e in got["views"]["full"]["elements"]}
    assert full["topic:/x</script>"] == "node:a/n3" and full["node:a/n3"] == "pkg:a" and full["pkg:b"] is None
    # what nesting shows is no edge, and a package that only holds is there
    assert len(got["views"]["full"]["edges"]) == 13
    assert {e["id"] for e in got["views"]["comms"]["elements"]} == set(full) - {"pkg:b"}


def test_page_by_levels(small, spark, tmp_path):
    got = embedded(render.page(small, "ws", size=5))["views"]["full"]
    assert not got["whole"] and {(e["id"], e["inside"]) for e in got["elements"]} == {("pkg:a", 13), ("pkg:b", 0)}
    assert got["edges"] == [{"src": "pkg:a", "dst": "pkg:b", "rel": "depends_on", "n": 1}]
    pieces = [embedded(render.page(small, "ws", "pkg:a", k, 5))["views"]["full"] for k in range(4)]
    assert [len(p["elements"]) for p in pieces] == [5, 5, 2, 0] and [len(p["edges"]) for p in pieces] == [5, 5, 1, 0]
    # the topic lies in the node that publishes to it: the others are drawn to that node, and its own edge is inside it
    assert {e["dst"] for p in pieces for e in p["edges"]} == {"node:a/n3"}
    render.write_levels(small, str(tmp_path / "levels"), 5)
    rows = spark.read.json(str(tmp_path / "levels" / "full"))
    assert rows.count() == 15 + 13
    inner = rows.filter("container = 'node:a/n3'").groupBy("part").agg(F.count("*")).collect()
    assert {tuple(r) for r in inner} == {("elements", 1), ("edges", 1)}
