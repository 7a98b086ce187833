"""Reachability, components and cycles against plain Python on random graphs."""

import itertools
import random

import pytest

from loomgraph.operators import graph, health, reach, rules


def closure_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reached = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), list(out.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        reached[a] = seen
    return reached


def cycles_of(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()

    def go(start, path):
        for x in out.get(path[-1], ()):
            if x == start:
                found.add(tuple(path))
            elif x > start and x not in path:
                go(start, [*path, x])

    for a in out:
        go(a, [a])
    return found


def random_graph(seed):
    rng = random.Random(seed)
    n = 26
    names = [f"v{i:02d}" for i in range(n)]
    edges = [(names[i], names[i // 2]) for i in range(1, n)]  # a tree: long paths, and nothing on a cycle
    for a in rng.sample(range(2, n - 2), 9):
        edges += [(names[a], names[a + 1]), (names[a + 1], names[a + rng.choice([-2, -1, 0, 1])])]
    edges += [(rng.choice(names), f"out{k}") for k in range(3)] + edges[:4]  # sinks, repeated edges
    edges += [("v20", "v21"), ("v21", "v22"), ("v22", "v20"), ("v21", "v20")]
    return edges


@pytest.fixture(scope="module", params=[1])
def edges(request):
    return random_graph(request.param)


def frame(spark, edges):
    return spark.createDataFrame([*edges, ("v01", None), (None, "v01"), (None, None)], "src string, dst string")


def test_reachable(spark, edges, monkeypatch):
    monkeypatch.setattr(reach, "PARTS", 2)  # what has been seen is written anew on the way
    reached = closure_of(edges)
    rng = random.Random(9)
    names = sorted({x for e in edges for x in e})
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [(a, a) for a in names[:6]] + [("v00", "nowhere"), ("nowhere", "v00")]
    asked = spark.createDataFrame([*pairs, pairs[0], ("v01", None), (None, "v01")], "src string, dst string")
    got = [tuple(r) for r in reach.reachable(frame(spark, edges), asked).collect()]
    assert sorted(got) == sorted({(a, b) for a, b in pairs if b in reached.get(a, ())})


def test_reachable_one_step_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(reach, "FEW", 0)
    chain = [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(12)]
    asked = spark.createDataFrame([("v00", "v12"), ("v03", "v11"), ("v05", "v04")], "src string, dst string")
    assert sorted(tuple(r) for r in reach.reachable(frame(spark, chain), asked).collect()) == [("v00", "v12"), ("v03", "v11")]


def test_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert reach.reachable(none, none).count() == 0 and reach.strong_components(none).count() == 0 and reach.simple_cycles(none).count() == 0
    asked = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert reach.reachable(none, asked).count() == 0 and reach.reachable(asked, none).count() == 0


def test_components(spark, edges):
    reached = closure_of(edges)
    want = {a: min(b for b in reached[a] if a in reached[b]) for a in reached if a in reached[a]}
    got = [tuple(r) for r in reach.strong_components(frame(spark, edges)).collect()]
    assert sorted(got) == sorted(want.items()) and len(want) > 5
    assert {r[0] for r in graph.cyclic(frame(spark, edges)).collect()} == set(want)


def test_components_that_feed_each_other(spark):
    # the least vertex reaches all, so components behind it wait for a later turn
    rings = [[f"{k}{x}" for x in "abc"] for k in "qzm"]
    arcs = [(r[i], r[(i + 1) % 3]) for r in rings for i in range(3)] + [(rings[0][0], rings[1][0]), (rings[1][2], rings[2][1]), ("a", "qa"), ("a", "a")]
    got = dict(reach.strong_components(frame(spark, arcs)).collect())
    assert got == {x: min(r) for r in rings for x in r} | {"a": "a"}


def test_cycles(spark, edges):
    got = [tuple(r["cycle"]) for r in reach.simple_cycles(frame(spark, edges)).collect()]
    assert sorted(got) == sorted(cycles_of(edges)) and len(got) > 3


def test_cycles_of_a_complete_graph(spark):
    arcs = list(itertools.permutations("abcde", 2))
    got = [tuple(r["cycle"]) for r in reach.simple_cycles(frame(spark, arcs)).collect()]
    assert sorted(got) == sorted(cycles_of(arcs)) and len(got) == 84
    with pytest.raises(ValueError, match="longer"):
        reach.simple_cycles(frame(spark, arcs), longest=2)


def test_rules_and_scores(spark):
    deps = frame(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "away")])
    known = spark.createDataFrame([(x, 5) for x in "abcd"], "name string, score int")
    pairs = [("a", "c"), ("a", "a"), ("c", "a"), ("gone", "gone"), ("d", "away")]
    assert {r["entity"] for r in rules.dependency_forbidden(deps, known, pairs).collect()} == {"a", "d"}
    assert rules.dependency_forbidden(deps, known, pairs).count() == 3
    assert [r["entity"] for r in rules.dependency_required(deps, known, pairs).collect()] == ["c"]
    scores = {r["name"]: r["score"] for r in health.deduct_cycles(known, deps).collect()}
    assert scores == {"a": 5, "b": 0, "c": 0, "d": 5}


def blocks(n):
    """n blocks of eight vertices, each a ring of five and a ring of three behind it, and each block behind the next one."""
    arcs = []
    for k in range(n):
        v = [f"b{k:03d}_{i}" for i in range(8)]
        arcs += [(v[i], v[(i + 1) % 5]) for i in range(5)] + [(v[4], v[5]), (v[5], v[6]), (v[6], v[7]), (v[7], v[5]), (f"b{k + 1:03d}_0", v[0])]
    return arcs


def watch(monkeypatch):
    """The tables that reach.py writes from now on, by tag, with their plans."""
    written, save = [], reach.save

    def told(df, tag):
        written.append((tag, df._jdf.queryExecution().toString()))
        return save(df, tag)

    monkeypatch.setattr(reach, "save", told)
    return written


def test_few_rounds_and_no_broadcast(spark, monkeypatch):
    # the rings of three are of the colour of those of five, and were found only in a second turn
    written = watch(monkeypatch)
    arcs = frame(spark, blocks(40))
    assert reach.strong_components(arcs).count() == 320
    assert len(written) <= 20
    assert reach.simple_cycles(arcs).count() == 80
    assert not [tag for tag, plan in written if "Broadcast" in plan]


@pytest.mark.parametrize("small", [0, 6])
def test_components_of_large_colours(spark, edges, monkeypatch, small):
    monkeypatch.setattr(reach, "SMALL", small)
    arcs = edges + blocks(2)
    reached = closure_of(arcs)
    want = {a: min(b for b in reached[a] if a in reached[b]) for a in reached if a in reached[a]}
    assert sorted(tuple(r) for r in reach.strong_components(frame(spark, arcs)).collect()) == sorted(want.items())


@pytest.mark.parametrize("condensed", [0, 1 << 30])
def test_reachable_either_way(spark, edges, monkeypatch, condensed):
    monkeypatch.setattr(reach, "CONDENSED", condensed)
    reached = closure_of(edges)
    names = sorted({x for e in edges for x in e})
    rng = random.Random(3)
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(40)} | {(a, a) for a in names[:8]} | {("v20", "v22"), ("v21", "v20"), ("v00", "nowhere"), ("nowhere", "nowhere")}
    got = [tuple(r) for r in reach.reachable(frame(spark, edges), spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()]
    assert sorted(got) == sorted((a, b) for a, b in pairs if b in reached.get(a, ()))


def test_pairs_without_a_path_are_not_searched(spark, monkeypatch):
    """Of pairs whose source reaches less than the target, none is walked from; those that are left give the same result."""
    edges = [(f"v{i:03d}", f"v{i // 2:03d}") for i in range(1, 200)] + [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(0, 200, 8)] + [("v050", "v197"), ("v197", "v198")]
    names = sorted({x for e in edges for x in e})
    pairs = [(f"v{i:03d}", f"v{i + 3:03d}") for i in range(190)] + [(f"v{i:03d}", f"v{i // 16:03d}") for i in range(190)] + [("v101", "v198"), ("v050", "nowhere")]
    walked = []
    searched = reach._searched
    monkeypatch.setattr(reach, "_searched", lambda arcs, left: walked.append(left.count()) or searched(arcs, left))
    reached = closure_of(edges)
    got = [tuple(r) for r in reach.reachable(frame(spark, edges), spark.createDataFrame(pairs, "src string, dst string")).collect()]
    want = sorted({(a, b) for a, b in pairs if b in reached.get(a, ())})
    assert sorted(got) == want and ("v101", "v198") in got
    assert len(names) == 200 and walked[0] < len(want) + 30
