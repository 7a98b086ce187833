"""Rules, summaries and connections over a name that many endpoints share."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, numbering, rules

ROWS = "package string, component string, role string, name string, msg_type string, seq bigint"


@pytest.fixture(scope="module")
def endpoints(spark):
    rows = [("p", f"c{i % 40}", "publishes" if i % 2 else "subscribes", "/hot", "T", i) for i in range(400)]
    rows += [("p", "c1", "publishes", "/said", "T", 900), ("q", "c1", "subscribes", "/heard", "T", 901), ("q", "c2", "calls", "/lost", "T", 902)]
    return spark.createDataFrame(rows, ROWS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules(endpoints):
    found = rules.topic_connectivity(endpoints).unionByName(rules.service_connectivity(endpoints))
    assert {(r["entity"], r["severity"], r["message"].rpartition(" ")[2]) for r in found.collect()} == {
        ("/heard", "warning", "c1"), ("/said", "info", "c1"), ("/lost", "warning", "c2"),
    }
    # summaries list nobody
    assert "collect_list" in plan(found)
    for summary in (rules.violation_summary(found), rules.findings_by_rule(found), found.groupBy("severity").count()):
        assert "collect_list" not in plan(summary)


def test_connections(endpoints):
    got = graph.connections(endpoints)
    assert {(r["component"], r["name"], r["others"]) for r in got.collect()} == {(f"c{i}", "/hot", 39) for i in range(40)}
    # components are counted per name and not paired
    assert "peer" not in plan(got)


# groups of any size: the same numbers, lists and digests however rows are dealt

def shuffled(spark, n=6000):
    # one name has a third of all rows, one is null, the others have a few each
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 and i % 5 == 0 else f"n{i % 700}", (i * 7919) % n, f"v{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "name string, seq bigint, value string").repartition(7).selectExpr("*", "value AS _part", "value AS _at")


def in_order(rows):
    groups = {}
    for name, seq, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(name, []).append((seq, value))
    return groups


@pytest.mark.parametrize("crowded", [100_000, 500, 0])
def test_numbers(spark, crowded):
    rows, table = shuffled(spark)
    got = {(r["name"], r["seq"]): r["nth"] for r in numbering.numbered(table, ["name"], ["seq"], crowded=crowded).collect()}
    assert got == {(name, seq): k for name, vs in in_order(rows).items() for k, (seq, _) in enumerate(vs, 1)}


def test_no_task_has_a_crowded_group(spark):
    _, table = shuffled(spark)
    placed = []
    keep = numbering.save
    try:
        numbering.save = lambda df, tag: (placed.append((tag, t)) if (t := keep(df, tag)) else None) or t
        numbering.numbered(table, ["name"], ["seq"], crowded=500)
    finally:
        numbering.save = keep
    most = dict(placed)["placed"].groupBy("_part").count().agg({"count": "max"}).first()[0]
    assert most < 2000 * 0.6  # the hot name has 2000 rows, and four partitions share them


@pytest.mark.parametrize("crowded", [100_000, 500])
def test_chunks(spark, crowded):
    rows, table = shuffled(spark)
    got = numbering.chunked(table, ["name"], ["seq"], table["value"], 100, crowded).collect()
    assert max(len(r["items"]) for r in got) == 100
    whole = {}
    for r in sorted(got, key=lambda r: r["chunk"]):
        assert r["first"] == len(whole.setdefault(r["name"], [])) + 1
        whole[r["name"]] += r["items"]
    assert whole == {name: [v for _, v in vs] for name, vs in in_order(rows).items()}


def test_digest_tree(spark):
    rows, table = shuffled(spark)

    def tree(lines, fan=8):
        digest = lambda part: hashlib.sha256("\n".join(part).encode()).hexdigest()
        level = [digest(lines[k : k + fan]) for k in range(0, len(lines), fan)]
        while len(level) > 1:
            level = [digest(level[k : k + fan]) for k in range(0, len(level), fan)]
        return level[0]

    want = {name: tree([v for _, v in vs]) for name, vs in in_order(rows).items()}
    for parts, crowded in ((1, 100_000), (5, 500)):
        got = numbering.tree_digests(table.repartition(parts), ["name"], "seq", table["value"], 8, crowded)
        assert {r["name"]: r["fingerprint"] for r in got.collect()} == want


def test_edges_of_one_pair(spark):
    rows = [("a", "b", "calls", i) for i in range(900)] + [("a", "c", "calls", 5)]
    table = spark.createDataFrame(rows, "src string, dst string, rel string, seq bigint").repartition(3)
    got = {(r["dst"], r["seq"]): r["key"] for r in graph.keyed(table, crowded=100).collect()}
    assert got == {("b", i): "calls" if i == 0 else f"calls#{i + 1}" for i in range(900)} | {("c", 5): "calls"}


def test_connections_factorised(spark, endpoints):
    members = {(r["component"], r["name"], r["seq"]): r["others"] for r in graph.connection_members(endpoints).collect()}
    pairs = graph.connection_rows(endpoints, endpoints)
    want = {}
    for r in pairs.collect():
        key = (r["component"], r["name"], r["seq"])
        want[key] = want.get(key, 0) + (r["peer_rel"] is not None)
    assert members == want
    lists = graph.peer_chunks(endpoints, 50).filter("name = '/hot' AND rel = 'publishes'").collect()
    assert sorted(len(r["components"]) for r in lists) == [50] * 4


def test_a_finding_names_some_and_counts_the_rest(spark, monkeypatch):
    monkeypatch.setattr(graph, "NAMED", 3)
    rows = [("p", f"c{i}", "subscribes", "/hot", "T", 100 - i) for i in range(10)] + [("p", "c1", "subscribes", "/few", "T", 0)]
    found = {r["entity"]: r["message"] for r in rules.topic_connectivity(spark.createDataFrame(rows, ROWS)).collect()}
    assert found["/hot"].endswith("subscribers: c9, c8, c7 and 7 more") and found["/few"].endswith("subscribers: c1")


def test_connections_are_dealt_to_all_cores(spark):
    rows = [("p", f"c{i}", "publishes", f"/n{i % 60}", "unknown", i) for i in range(240)]
    ends = spark.createDataFrame(rows, "package string, component string, role string, name string, msg_type string, seq long")
    met = graph.connection_rows(ends, ends.select("package", "component"))
    assert met.count() == 240 * 3
    assert met.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_connections_of_a_crowded_name_are_shared(spark):
    rows = [("p", f"c{i}", "subscribes" if i % 3 else "publishes", "/hot", "T", i) for i in range(300)]
    # alone at a name, with itself only, and where the name, a package or a component is not known
    rows += [("p", "c1", "publishes", "/own", "T", 900), ("p", "c1", "subscribes", "/own", "T", 901), ("p", "c2", "provides", "/lone", "T", 902), ("p", "c3", "publishes", None, "T", 903)]
    rows += [("p", "c4", "publishes", "/half", "T", 904), ("q", None, "publishes", "/half", "T", 905), (None, "c4", "publishes", "/half", "T", 906), ("p", "c5", "odd", "/hot", "T", 907)]
    rows += [("p", f"c{i}", "provides" if i % 2 else "calls", "/few", "T", 1000 + i) for i in range(10)]
    ends = spark.createDataFrame(rows, ROWS)
    met = graph.connection_rows(ends, ends.filter("package = 'p'"), block=20).cache()

    def side(role):
        return "Topic" if role in ("publishes", "subscribes") else "Service" if role in ("provides", "calls") else None

    want = []
    for p, c, role, name, kind, seq in ((*r[:4], side(r[2]), r[5]) for r in rows if r[0] == "p"):
        peers = [r for r in rows if name is not None and kind and r[3] == name and side(r[2]) == kind and r[2] != "provides"]
        peers = [r for r in peers if (r[0] is not None and r[0] != p) or (r[1] is not None and r[1] != c)]
        want += [(c, name, kind, seq, r[2], r[5]) for r in peers] or [(c, name, kind, seq, None, None)]
    got = [(r["component"], r["name"], r["kind"], r["seq"], r["peer_rel"], r["peer_seq"]) for r in met.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    hot = [r["count"] for r in met.filter("name = '/hot' AND peer_rel IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(hot) == 300 * 299 and max(hot) < 0.4 * sum(hot)
