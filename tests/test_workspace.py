"""A small workspace of our own, from files to findings."""

import json
import textwrap

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import assembly, graph
from loomgraph.operators.packages import listed, node_table
from loomgraph.plans import model, policy, render, sinks
from loomgraph.sources import cache, launch, tree, workspace

FILES = {
    "alpha/package.xml": """
        <package><name>alpha</name><version>1.2.0</version><description>Talks to others</description><license>MIT</license>
        <maintainer email="a@b.co">Ann</maintainer><depend>beta</depend><test_depend>check_lib</test_depend>
        <export><build_type>ament_python</build_type></export></package>""",
    "alpha/README.md": "alpha",
    "alpha/test/test_it.py": "x = 1",
    "alpha/alpha/_private.py": """
        from msgs_a.msg import Text as T
        from rclpy.node import Node
        import std.srv


        class Speaker(Node):
            TOPIC = "words"

            def __init__(self):
                self.where = "/loud"
                self.create_publisher(T, "words", 10)
                self.create_publisher(T, self.where, 10)
                self.create_subscription(std.msg.Number, topic=pick(), callback=None)
                self.create_client(std.srv.Ask, "/ask")


        class Idle(Node):
            pass
        """,
    "alpha/launch/go.py": """
        def generate():
            return [Node(package="alpha", executable="speaker", namespace="room", remappings=[("/loud", "/quiet")])]
        """,
    "beta/package.xml": "<package><name>beta</name><version>0.0.0</version><depend>alpha</depend><build_depend>ament_cmake</build_depend></package>",
    "beta/msg/Words.msg": "# a comment\nstring text\n---\n\nint32 n\n",
    "beta/src/hear.cpp": r"""
        // class Not : public rclcpp::Node { create_publisher<A>("no"); };
        class Hearer final : public rclcpp::Node {
          void f() {
            sub_ = create_subscription<std_msgs::msg::String>(topic("/quiet"), [this](auto m) { use("}"); });
            srv_ = this->create_service<std::srv::Ask>(name_, cb);
            act_ = rclcpp_action::create_server<move::action::Go>(this, "go", a, b);
          }
        };
        """,
    "beta/launch/x.launch.xml": '<launch><group><node pkg="beta" exec="hearer" name="Hearer"><remap from="a" to="b"/></node></group><include file="y.xml"/></launch>',
    "beta/launch/bad.launch.yaml": "launch: null",
    "beta/launch/ok.launch.yaml": "launch: [{node: {package: beta, executable: other}}]",
    "broken/package.xml": "<package><name>",
    "skipped/.rosignore": "",
    "skipped/package.xml": "<package/>",
    "build/gamma/package.xml": "<package/>",
    "alpha/nested/package.xml": "<package><name>nested</name></package>",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    for path, text in FILES.items():
        file = top / "src" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(textwrap.dedent(text).strip())
    return str(top)


@pytest.fixture(scope="module")
def made(spark, root):
    return model.read(spark, root)


def test_discovery(made, root):
    assert {r["name"]: (r["package_type"], r["version"], r["license"]) for r in made.packages.collect()} == {
        "alpha": ("ament_python", "1.2.0", "MIT"), "beta": ("ament_cmake", "0.0.0", None)
    }
    assert workspace.workspace_root(f"{root}/src/alpha") == root and workspace.source_root(root).endswith("/src")


def test_endpoints(made):
    got = {(r["component"], r["role"], r["name"], r["msg_type"]) for r in made.endpoints.collect()}
    assert got == {
        ("Speaker", "publishes", "/room/words", "msgs_a/Text"), ("Speaker", "publishes", "/quiet", "msgs_a/Text"),
        ("Speaker", "subscribes", "<dynamic>", "std/Number"), ("Speaker", "calls", "/ask", "std/Ask"),
        ("Hearer", "subscribes", "/quiet", "std_msgs/String"), ("Hearer", "provides", "<dynamic>", "std/Ask"), ("Hearer", "serves", "go", "move/Go"),
    }
    flags = {r["name"]: r["has_dynamic_names"] for r in made.components.collect()}
    assert flags == {"Speaker": True, "Idle": False, "Hearer": True}


def test_launch(spark, root, made):
    records = launch.launch_records(workspace.files(spark, root + "/src"))
    assert {(r["source_file"], r["executable"], r["name"]) for r in launch.launch_nodes(records).collect()} == {
        ("launch/go.py", "speaker", "<unknown>"), ("launch/x.launch.xml", "hearer", "Hearer"), ("launch/ok.launch.yaml", "other", None)
    }
    assert [r["target_file"] for r in launch.launch_includes(records).collect()] == ["y.xml"]
    assert {r["code"] for r in made.diagnostics.collect()} == {"launch_unresolved", "type_conflict", "manifest_unreadable"}


def test_graph(made):
    kinds = {r["kind"]: r["n"] for r in assembly.summary(made.vertices).collect()}
    assert kinds == {"Package": 2, "Node": 3, "Topic": 3, "Service": 2, "Action": 1, "Interface": 1}
    edges = {(r["src"], r["dst"], r["key"]) for r in made.edges.collect()}
    assert ("pkg:alpha", "pkg:beta", "depends_on") in edges and ("node:beta/Hearer", "pkg:beta", "defined_in") in edges
    vertices, inner = graph.focus(made.vertices, made.edges, "Hearer")
    assert vertices.filter("id = 'topic:/quiet'").count() == 1 and inner.filter("src <> 'node:beta/Hearer'").count() == 0
    assert made.interfaces.first()["fields"] == ["string text", "int32 n"]
    lines = list(render.mermaid(made, "deps"))
    assert lines[0] == "graph LR" and len(lines) == 5 and len(list(render.dot(made, "comms"))) > 10
    assert all(json.loads(x) for x in render.graph_json(made)) and "<h1>" in next(render.page(made, "ws"))
    met = graph.connection_rows(made.endpoints, made.endpoints.filter("role = 'publishes'").select("package", "component"))
    assert ("Speaker", "/quiet", "subscribes", "Hearer") in {(r["component"], r["name"], r["peer_rel"], r["peer_component"]) for r in met.collect()}


def test_compound(made):
    elements, edges = graph.compound(made.vertices, made.edges.withColumn("seq", F.col("key")))
    got = {r["id"]: r for r in elements.collect()}
    assert got["node:beta/Hearer"]["parent"] == "pkg:beta" and got["pkg:beta"]["parent"] is None
    assert got["topic:/quiet"]["parent"] == "node:alpha/Speaker"
    assert not {r["rel"] for r in edges.select("rel").distinct().collect()} & {"defined_in", "uses_interface"}


def test_export(made, tmp_path):
    render.export(made, str(tmp_path))
    names = {p.name for p in tmp_path.iterdir()}
    assert names >= {"packages", "nodes", "interfaces", "topics", "services", "actions", "launch_remaps", "diagnostics", "summary", "vertices", "edges"}
    written = [json.loads(x) for f in (tmp_path / "topics").glob("part-*") for x in f.read_text().splitlines()]
    assert {"/quiet"} <= {r["name"] for r in written} and all("msg_type" in r for r in written)
    # the full view in JSON says all of it too
    parts = {json.loads(x)["part"] for x in render.graph_json(made, "full")}
    assert parts >= {"packages", "nodes", "interfaces", "topics", "services", "actions", "summary", "vertices", "edges"}


def test_source(spark, root):
    """Hidden names are listed, links and left-out directories are not walked, filters on suffix reach the tasks, and a URI is as good as a path."""
    rows = tree.load(spark, f"{root}/src").collect()
    got = {(r["package"], r["rel_path"]) for r in rows}
    assert {("alpha", "alpha/_private.py"), ("alpha", "test"), ("alpha", "nested/package.xml"), ("broken", "package.xml")} <= got
    assert {r["package"] for r in rows} == {"alpha", "beta", "broken"} and len(got) == len(rows)
    python = tree.load(spark, f"{root}/src", content=True).filter("suffix = '.py'")
    assert "PushedFilters: [EqualTo" in (p := python._jdf.queryExecution().toString()) or "suffix" in p
    assert {(r["rel_path"], r["text"]) for r in python.collect() if r["package"] == "alpha"} >= {("test/test_it.py", "x = 1")}
    some = tree.load(spark, f"{root}/src").filter(F.col("suffix").isin(".msg", ".hpp")).collect()
    assert [r["rel_path"] for r in some] == ["msg/Words.msg"]
    remote = tree.load(spark, f"file://{root}/src").collect()
    assert {(r["package"], r["rel_path"], r["is_dir"]) for r in remote} == {(r["package"], r["rel_path"], r["is_dir"]) for r in rows}
    assert workspace.workspace_root(f"file://{root}/src/alpha") == f"file://{root}" and workspace.source_root(f"file://{root}").endswith("/src")


def test_source_is_cut_into_partitions(root, monkeypatch):
    monkeypatch.setattr(tree, "CUTS", 3)
    reader = tree.Reader({"path": f"{root}/src", "content": "false"})
    parts = reader.partitions()
    assert 1 < len(parts) <= 5
    few = {(r[0], r[2]) for p in parts for r in reader.read(p)}
    whole = {(r[0], r[2]) for r in reader.read(tree.Part(f"{root}/src", 0))}
    assert few == whole and ("beta", "src/hear.cpp") in whole
    with pytest.raises(OSError):
        tree.Reader({"path": f"{root}/nowhere"}).partitions()


def test_one_changed_file_parses_one_file(spark, tmp_path, monkeypatch):
    """A model that is read again parses what has changed, and says what a model read anew says."""
    src = tmp_path / "src" / "one"
    src.mkdir(parents=True)
    (src / "package.xml").write_text("<package><name>one</name></package>")
    for name in ("a", "b", "c"):
        (src / f"{name}.py").write_text(f"class {name.upper()}(Node):\n    def f(self):\n        self.create_publisher(T, '/{name}', 1)\n")
    asked = []
    parse = workspace.python_records
    monkeypatch.setattr(workspace, "python_records", lambda listing: asked.append(sorted(r["name"] for r in listing.filter("suffix = '.py'").collect())) or parse(listing))
    store = f"file://{tmp_path}/store"

    def names(m):
        return sorted((r["component"], r["name"], r["file_path"]) for r in m.endpoints.collect())

    def run():
        return names(model.read(spark, str(tmp_path), store))

    assert run() == [("A", "/a", "a.py"), ("B", "/b", "b.py"), ("C", "/c", "c.py")] == run()
    (src / "b.py").write_text("class B(Node):\n    def f(self):\n        self.create_client(T, '/new')\n")
    (src / "c.py").unlink()
    assert run() == [("A", "/a", "a.py"), ("B", "/new", "b.py")]
    assert asked == [["a.py", "b.py", "c.py"], [], ["b.py"]]
    listing = workspace.files(spark, f"{tmp_path}/src")
    before = spark.createDataFrame([("one", "a.py", cache.digests(listing).filter("rel_path = 'a.py'").first()["digest"]), ("one", "b.py", "old"), ("one", "c.py", "x")], "package string, rel_path string, digest string")
    states = {r["rel_path"]: r["state"] for r in cache.changes(cache.digests(listing), before).collect()}
    assert states == {"a.py": "kept", "b.py": "changed", "c.py": "gone", "package.xml": "new"}


def test_written_diagrams(spark, made, tmp_path):
    for form, lines in (("mermaid", render.mermaid), ("dot", render.dot)):
        render.write(made, f"file://{tmp_path}/{form}", form, "full")
        assert sinks.read_document(spark, f"file://{tmp_path}/{form}") == list(lines(made, "full"))


def test_node_table(made):
    got = {r["name"]: r.asDict() for r in node_table(made.components, made.endpoints).collect()}
    assert list(got) == ["Idle", "Speaker (dynamic)", "Hearer (dynamic)"]
    assert got["Speaker (dynamic)"]["publishes"] == "/room/words, /quiet" and got["Idle"]["calls"] == "—" and got["Hearer (dynamic)"]["serves"] == "go"


def test_commands(spark, root, tmp_path, capsys):
    from loomgraph.__main__ import main

    assert main(["packages", root, "--show-deps", "-f", "json"]) == 0
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"alpha", "beta"}
    out = tmp_path / "graph.dot"
    assert main(["graph", root, "-f", "dot", "--view", "comms", "-o", str(out)]) == 0
    assert out.read_text().startswith("digraph")
    assert main(["nodes", root, "-p", "alpha", "--show-connections"]) == 0
    assert "Hearer" in capsys.readouterr().out
    assert main(["audit", root, "-f", "json", "--fail-on", "info"]) == 1
    told = json.loads(capsys.readouterr().out)
    assert told["total_packages"] == 2 and told["violations"]["info"] + told["violations"]["warnings"] > 0
    assert main(["scan", str(tmp_path / "nowhere")]) == 3
    assert main(["packages", root, "-t", "meta"]) == 0
    said = capsys.readouterr()
    assert "no packages match" in said.err and "alpha" not in said.out


def test_python_scopes(spark):
    """Constants seen so far, names of the class body, and classes inside classes."""
    text = """
class A(Node):
    X = "/x"
    def one(self):
        self.create_publisher(T, self.y, 1)
        self.y = "/y"
        self.create_publisher(T, self.y, 1)
    class B(Node):
        def two(self):
            self.create_publisher(T, self.X, 1)
            self.create_publisher(T, topic="/b")
    def three(self):
        y = "/local"
        self.create_publisher(T, y, 1)
        self.create_publisher(T, X, 1)
"""
    rows = workspace.python_texts(spark.createDataFrame([(text, "a.py", "p"), ("def (", "b.py", "p")], "text string, rel_path string, package string")).collect()
    assert [(r["component"], r["name"]) for r in rows] == [
        ("B", None), ("B", "<dynamic>"), ("B", "/b"), ("A", None), ("A", "<dynamic>"), ("A", "/y"), ("A", "/y"), ("A", "/x"),
    ]


def test_inferred(spark):
    vertices = spark.createDataFrame([("topic:/x/Words", "Topic", "/x/Words", "unknown", []), ("topic:y", "Topic", "y", "a/B", ["a/B"])], "id string, kind string, name string, msg_type string, observed_types array<string>")
    interfaces = spark.createDataFrame([("p", "Words"), ("q", "Y"), ("r", "y")], "package string, name string")
    got = {r["name"]: (r["msg_type"], r["type_source"]) for r in assembly.infer_types(vertices, interfaces).collect()}
    assert got == {"/x/Words": ("p/Words", "inferred_name_match"), "y": ("a/B", "explicit")}


def test_scores(made):
    # alpha: all but the cycle; beta: no license, people, version, readme, test folder or test dependency
    assert {r["name"]: r["score"] for r in made.scores.collect()} == {"alpha": 90, "beta": 25}
    assert [r["name"] for r in listed(made.packages.join(made.scores.withColumnRenamed("score", "health_score"), "name"), None, "health").collect()] == ["alpha", "beta"]


def test_policy(made):
    every = policy.check({"version": 1, "rules": [
        {"type": "health_threshold", "workspace_min_score": 99}, {"type": "license", "allowed": ["BSD"]}, {"type": "naming", "nodes": {}, "topics": {"pattern": "(?P<a>/q)"}},
        {"type": "dependency", "forbidden": [{"from": "alpha", "to": "alpha"}], "required": [{"package": "alpha", "depends_on": "far"}]},
        {"type": "no_circular_deps"}, {"type": "maintainer_required", "require_email": True}, {"type": "version_not_default"}, *policy.AUDIT,
    ]})
    found = policy.evaluate(made, every)
    by_rule = {}
    for r in found.collect():
        by_rule.setdefault(r["rule_type"], set()).add(r["entity"])
    assert by_rule == {
        "health_threshold": {"beta", "workspace"}, "license": {"alpha", "beta"}, "naming": {"Speaker", "Idle", "Hearer", "/room/words", "<dynamic>"},
        "dependency": {"alpha"}, "no_circular_deps": {"alpha"}, "maintainer_required": {"beta"}, "version_not_default": {"beta"},
        "topic_connectivity": {"/room/words", "<dynamic>"}, "node_isolation": {"Idle"}, "service_connectivity": {"/ask", "<dynamic>"}, "action_connectivity": {"go"},
    }
    assert render.report(found)["violations"]["errors"] == 4


@pytest.mark.parametrize("bad", [
    [], {"version": 2, "rules": []}, {"version": 1, "rules": {}}, {"version": 1, "rules": [{"type": "no"}]}, {"version": 1, "rules": [{"type": "license", "severity": "bad"}]},
    {"version": 1, "rules": [{"type": "naming", "nodes": {"pattern": "("}}]}, {"version": 1, "rules": [{"type": "dependency", "forbidden": [{"from": "a"}]}]},
])
def test_bad_policies(bad):
    with pytest.raises(policy.PolicyError):
        policy.check(bad)


def test_no_packages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    with pytest.raises(assembly.WorkspaceError):
        model.read(spark, str(tmp_path))


def test_fingerprints(spark, root):
    listing = workspace.files(spark, root + "/src")
    one = {r["package"]: r["fingerprint"] for r in workspace.fingerprints(listing).collect()}
    assert set(one) == {"alpha", "beta", "broken"} and len(set(one.values())) == 3


def test_cache(spark, tmp_path):
    """What is read from the cache is what would be parsed, and only changed packages are parsed."""
    from loomgraph.sources.cache import cached

    src = tmp_path / "ws" / "src"
    for name, topic in (("one", "/a"), ("two", "/b"), ("none", None)):
        (src / name).mkdir(parents=True)
        (src / name / "package.xml").write_text(f"<package><name>{name}</name></package>")
        if topic:
            (src / name / "n.py").write_text(f"class N(Node):\n    def f(self):\n        self.create_publisher(T, '{topic}', 1)\n")
    parsed = []

    def parse(listing):
        parsed.append({r["package"] for r in listing.select("package").distinct().collect()})
        return workspace.python_records(listing)

    def run():
        listing = workspace.files(spark, str(src))
        got = cached(listing, parse, f"file://{tmp_path}/cache")
        assert sorted(map(str, got.collect())) == sorted(map(str, workspace.python_records(listing).collect()))

    run()
    run()
    (src / "two" / "n.py").write_text("class M(Node):\n    pass\n")
    run()
    assert parsed == [{"one", "two", "none"}, set(), {"two"}]


def test_stream(spark, tmp_path):
    from loomgraph.streaming.observations import topic_activity

    rows = [("2024-01-01 00:10:00", "/a", "publishes"), ("2024-01-01 00:20:00", "/a", "publishes"), ("2024-01-01 01:05:00", "/a", "subscribes"), ("2024-01-01 09:00:00", "/b", "calls")]
    spark.createDataFrame(rows, "ts string, name string, role string").selectExpr("cast(ts AS timestamp) AS ts", "name", "role").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, name string, role string").parquet(f"{tmp_path}/in")
    query = topic_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(str(r["window"]["start"]), r["name"], r["role"]): r["n"] for r in spark.table("activity").collect()}
    assert got == {("2024-01-01 00:00:00", "/a", "publishes"): 2, ("2024-01-01 01:00:00", "/a", "subscribes"): 1, ("2024-01-01 09:00:00", "/b", "calls"): 1}
