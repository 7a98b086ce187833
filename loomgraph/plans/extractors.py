"""Named queries that run the extractors over stored sources, one set of files for each supplier, and their SQL twins.

{k} and {m} in a file stand for the supplier's key and its remainder by 3; the twins say in plain
rows what each file declares.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cpp, launch, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str, files: Sequence[tuple[str, str]], which: str = "true") -> DataFrame:
    """(s_suppkey, package, root, rel_path, text) of (path, text) templates, for the suppliers of a condition."""
    own = spark.read.parquet(f"{d}/supplier.parquet").filter(which)
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{m}"), (F.col("s_suppkey") % 3).cast("string"))
    each = F.explode(F.array(*(F.struct(filled(path).alias("rel_path"), filled(text).alias("text")) for path, text in files))).alias("f")
    package = F.concat(F.lit("pkg_"), F.col("s_suppkey").cast("string"))
    return own.select("s_suppkey", package.alias("package"), F.lit("/w").alias("root"), each).select("s_suppkey", "package", "root", "f.*")


def _twin(names: Sequence[str], rows: Sequence[tuple], which: str = "true") -> str:
    """SQL of the same rows for every supplier: strings are templates, everything else is as it is."""

    def value(x) -> str:
        if x is None:
            return "NULL"
        if not isinstance(x, str):
            return f"{x}::BIGINT"
        return "replace(replace('" + x.replace("'", "''") + "', '{k}', cast(s_suppkey AS VARCHAR)), '{m}', cast(s_suppkey % 3 AS VARCHAR))"

    return " UNION ALL ".join(f"SELECT {', '.join(f'{value(x)} AS {n}' for n, x in zip(names, row, strict=True))} FROM supplier WHERE {which}" for row in rows)


_RECORD = ("package", "component", "role", "name", "msg_type", "file_path", "line", "evidence")

_PYTHON = """from std_msgs.msg import String
from my.pkg_{m}.srv import Add as Sum
import pkg.action


def helper(node):
    node.create_publisher(String, '/outside', 1)


class Outer{k}(Node):
    TOPIC = '/t{k}'

    def __init__(self):
        local = '/never'
        self.create_client(Sum, self.late)
        self.late = '/late'
        self.create_publisher(String, self.TOPIC, 10)
        self.create_subscription(String, TOPIC, None, 10)
        self.create_client(Sum, local)
        self.create_client(Sum, srv_name=self.late)

    class Inner(rclpy.node.Node):
        def go(self):
            self.create_service(Sum, '/s{k}', None)
            ActionServer(self, pkg.action.Fib, action_name='/a{k}')
            self.create_publisher(Unknown, self.TOPIC, 1)


class Plain:
    def go(self):
        self.create_publisher(String, '/plain', 1)
"""


@_query(_twin(_RECORD, [
    ("pkg_{k}", "Inner", None, None, None, "n{k}.py", 22, None),
    ("pkg_{k}", "Inner", "provides", "/s{k}", "my.pkg_{m}/Add", "n{k}.py", 24, "create_service"),
    ("pkg_{k}", "Inner", "serves", "/a{k}", "pkg/Fib", "n{k}.py", 25, "ActionServer"),
    ("pkg_{k}", "Inner", "publishes", "<dynamic>", "Unknown", "n{k}.py", 26, "create_publisher"),
    ("pkg_{k}", "Outer{k}", None, None, None, "n{k}.py", 10, None),
    ("pkg_{k}", "Outer{k}", "calls", "<dynamic>", "my.pkg_{m}/Add", "n{k}.py", 15, "create_client"),
    ("pkg_{k}", "Outer{k}", "publishes", "/t{k}", "std_msgs/String", "n{k}.py", 17, "create_publisher"),
    ("pkg_{k}", "Outer{k}", "subscribes", "/t{k}", "std_msgs/String", "n{k}.py", 18, "create_subscription"),
    ("pkg_{k}", "Outer{k}", "calls", "<dynamic>", "my.pkg_{m}/Add", "n{k}.py", 19, "create_client"),
    ("pkg_{k}", "Outer{k}", "calls", "/late", "my.pkg_{m}/Add", "n{k}.py", 20, "create_client"),
]))
def python_sources(spark, d):
    return workspace.python_texts(_files(spark, d, [("n{k}.py", _PYTHON), ("broken.py", "class (:")]))


_CPP = """// create_publisher<std_msgs::msg::String>("/comment", 1)
class Talker{k} : public rclcpp::Node {
  Talker{k}() : Node("x") {
    pub_ = create_publisher<std_msgs::msg::String>("/t{k}", 10);
    sub_ = this->create_subscription<sensor_msgs::msg::Image>(topic_, 10, cb);
    srv_ = create_service<pkg{m}::srv::Add>("/s{k}", [](auto a) { return f(a, "no"); });
    act_ = rclcpp_action::create_server<pkg{m}::action::Fib>(this, "/a{k}", g, c, a);
  }
};
class Other : public Base { void f() { create_publisher<A>("/other", 1); } };
class Managed : private Base, public rclcpp_lifecycle :: LifecycleNode { void f() { c_ = create_client<pkg::srv::Add>("/s{k}"); } };
"""


@_query(_twin(_RECORD, [
    ("pkg_{k}", "Talker{k}", None, None, None, "n{k}.cpp", 2, None),
    ("pkg_{k}", "Talker{k}", "publishes", "/t{k}", "std_msgs/String", "n{k}.cpp", 4, "create_publisher"),
    ("pkg_{k}", "Talker{k}", "subscribes", "<dynamic>", "sensor_msgs/Image", "n{k}.cpp", 5, "create_subscription"),
    ("pkg_{k}", "Talker{k}", "provides", "/s{k}", "pkg{m}/Add", "n{k}.cpp", 6, "create_service"),
    ("pkg_{k}", "Talker{k}", "serves", "/a{k}", "pkg{m}/Fib", "n{k}.cpp", 7, "rclcpp_action"),
    ("pkg_{k}", "Managed", None, None, None, "n{k}.cpp", 11, None),
    ("pkg_{k}", "Managed", "calls", "/s{k}", "pkg/Add", "n{k}.cpp", 11, "create_client"),
]))
def cpp_sources(spark, d):
    return cpp.cpp_texts(_files(spark, d, [("n{k}.cpp", _CPP)]))


_LAUNCH_XML = """<launch><node pkg="p{m}" exec="e{k}" name="n{k}" ns="room"><remap from="/a" to="/b{k}"/></node><group><node pkg="q" type="old"/></group><include file="inc{k}.xml"/></launch>"""
_LAUNCH_PY = """def generate_launch_description():
    return LaunchDescription([
        Node(package='p{m}', executable='e{k}', remappings=[('/a', '/b{k}')]),
        IncludeLaunchDescription('inc{k}.py'),
        OpaqueFunction(function=later),
    ])
"""
_LAUNCH_YAML = """launch:
  - node:
      package: p{m}
      executable: e{k}
      name: n{k}
  - arg: {name: x}
"""
_LAUNCHED = ("kind", "owner_package", "executable", "package", "name", "remaps", "namespace", "target", "file_path", "place")


@_query(_twin(_LAUNCHED, [
    ("node", "pkg_{k}", "e{k}", "p{m}", "n{k}", "/a=/b{k}", "room", None, "x.launch.xml", 0),
    ("node", "pkg_{k}", "old", "q", None, "", None, None, "x.launch.xml", 1),
    ("include", "pkg_{k}", None, None, None, None, None, "inc{k}.xml", "x.launch.xml", 2),
    ("node", "pkg_{k}", "e{k}", "p{m}", "<unknown>", "/a=/b{k}", "<unknown>", None, "x.launch.py", 0),
    ("include", "pkg_{k}", None, None, None, None, None, "inc{k}.py", "x.launch.py", 1),
    ("unresolved", "pkg_{k}", None, None, None, None, None, None, "x.launch.py", 2),
    ("node", "pkg_{k}", "e{k}", "p{m}", "n{k}", "", None, None, "x.launch.yaml", 0),
    ("unresolved", "pkg_{k}", None, None, None, None, None, None, "y.launch.yaml", 0),
]))
def launch_sources(spark, d):
    files = [("x.launch.xml", _LAUNCH_XML), ("x.launch.py", _LAUNCH_PY), ("x.launch.yaml", _LAUNCH_YAML), ("y.launch.yaml", "launch: null"), ("z.launch.yaml", "just text"), ("bringup/rates.yaml", "node_{k}: {rate: 10}")]
    pairs = F.array_join(F.transform(F.map_entries("remaps"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return launch.launch_texts(_files(spark, d, files)).withColumn("remaps", pairs).select(*_LAUNCHED)


_TOLD = ("name", "version", "package_type", "maintainers", "license", "description", "path", "deps")
_BUILT = """<?xml version="1.0"?>
<package format="3"><name> built{k} </name><version>1.{m}.0</version><description>Does {k} things</description><license>MIT</license><license>BSD</license>
<maintainer email="a{k}@x.org">Ann</maintainer><maintainer>Bo</maintainer><depend>one</depend><depend> </depend><build_depend>two</build_depend>
<exec_depend>three</exec_depend><test_depend>four</test_depend><build_export_depend>five</build_export_depend>
<export/><export><build_type> cmake </build_type><metapackage_like/></export></package>"""
_META = """<package><name>meta{k}</name><export><build_type>ament_cmake</build_type><metapackage/></export></package>"""
_BARE = """<package><build_depend>x</build_depend><build_depend>ament_python</build_depend></package>"""


@_query(
    _twin(_TOLD, [("built{k}", "1.{m}.0", "cmake", "Ann <a{k}@x.org>, Bo <>", "MIT", "Does {k} things", "/w", "depend one, build two, exec three, test four, build_export five")], "s_suppkey % 4 = 0")
    + " UNION ALL " + _twin(_TOLD, [("meta{k}", "0.0.0", "meta", "", None, None, "/w", "")], "s_suppkey % 4 = 1")
    + " UNION ALL " + _twin(_TOLD, [("pkg_{k}", "0.0.0", "ament_python", "", None, None, "/w", "build x, build ament_python")], "s_suppkey % 4 = 2")
)
def manifest_sources(spark, d):
    texts = [(_BUILT, 0), (_META, 1), (_BARE, 2), ("<package><name>x</package>", 3)]
    parts = [_files(spark, d, [("package.xml", text)], f"s_suppkey % 4 = {k}") for text, k in texts]
    told = workspace.package_records(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    deps = F.array_join(F.transform("deps", lambda x: F.concat(x["dep_type"], F.lit(" "), x["dep_name"])), ", ")
    return told.withColumns({"deps": deps, "maintainers": F.array_join("maintainers", ", ")}).select(*_TOLD)
