"""Model tables derived from the driver's tables, in SQL that both engines read but for a few functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENDPOINTS = """
SELECT concat('pkg_', user_id % 7) AS package, concat('user_', user_id) AS component,
  CASE event_type WHEN 'purchase' THEN 'publishes' WHEN 'signup' THEN 'provides' WHEN 'error' THEN 'calls' ELSE 'subscribes' END AS role,
  concat('/d', day(ts), '/k', {json}) AS name,
  CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE concat('msgs/T', user_id % 3) END AS msg_type,
  event_id AS seq
FROM {events}"""

_PAIRS = """
SELECT concat('nation_', s.s_nationkey) AS src, concat('nation_', c.c_nationkey) AS dst, sum(cast(l.l_quantity AS BIGINT)) AS q
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_nationkey, c.c_nationkey"""

_DEPS = f"SELECT src, dst FROM ({_PAIRS}) p"

# Every document depends on the one of half its number, and on two of its eight neighbours that its length picks: paths are long, and cycles are local.
_NUMBER = "concat('doc_', lpad(cast({n} AS STRING), 9, '0'))"
_CHAIN = " UNION ALL ".join(
    f"SELECT {_NUMBER.format(n='doc_id')} AS src, {_NUMBER.format(n=to)} AS dst FROM {{documents}}"
    for to in (
        "cast(floor(doc_id / 2) AS BIGINT)", "doc_id - doc_id % 8 + (doc_id + 1 + n_chars % 7) % 8", "doc_id - doc_id % 8 + (doc_id + cast(floor(n_chars / 5) AS BIGINT)) % 8",
    )
)

# Of each document it is asked whether it depends on the one of a 256th of its number, and on the third one behind it.
_ASKED = " UNION ALL ".join(
    f"SELECT {_NUMBER.format(n='doc_id')} AS src, {_NUMBER.format(n=to)} AS dst FROM {{documents}}" for to in ("cast(floor(doc_id / 256) AS BIGINT)", "doc_id + 3")
)

_NUMBERED = f"SELECT {_NUMBER.format(n='doc_id')} AS name, cast(n_chars % 101 AS INT) AS score FROM {{documents}}"

_SIGNALS = """
SELECT source AS name, bool_or(length(text) > 5) AS has_description, bool_or(text LIKE '%icensed under%') AS has_license,
  bool_or(n_chars > 1000) AS has_maintainer, bool_or(text LIKE '%@%') AS has_maintainer_email, bool_or(lang = 'fr') AS has_version,
  bool_or(n_chars > 8000) AS has_readme, bool_and(n_chars < 40000) AS no_self_dependency, bool_or(lang = 'de') AS has_test_dir,
  bool_or(text LIKE '%token%') AS test_deps_declared, bool_or(n_chars > 15000) AS has_launch_files
FROM {documents} GROUP BY source"""

_PACKAGES = """
SELECT concat('nation_', n_nationkey) AS name, CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 5 = 1 THEN NULL ELSE concat('License-', n_nationkey % 3) END AS license,
  CASE WHEN n_nationkey % 4 = 0 THEN '0.0.0' ELSE concat('1.', n_nationkey, '.0') END AS version, n_name AS label FROM {nation}"""

# The first parts have a name of their own, all others share 41 names.
_INTERFACES = """
SELECT concat('pkg_', p_partkey % 7) AS package, concat('k', CASE WHEN p_partkey < 60 THEN p_partkey ELSE 60 + p_partkey % 41 END) AS name, p_partkey AS seq FROM {part}"""

_LAUNCH = """
SELECT concat('pkg_', c_custkey % 7) AS owner_package, concat('user_', c_custkey) AS executable, concat('pkg_', c_custkey % 7) AS package,
  CASE WHEN c_custkey % 5 = 0 THEN concat('user_', c_custkey) END AS name, concat('/d', c_custkey % 28 + 1, '/k', c_custkey % 10) AS remap_from,
  concat('/moved/', c_custkey) AS remap_to, CASE WHEN c_custkey % 3 = 0 THEN concat('room', c_nationkey) END AS namespace, c_custkey AS seq FROM {customer}"""

_COMPONENTS = """SELECT concat('pkg_', c_custkey % 7) AS package, concat('user_', c_custkey) AS name, c_custkey AS seq FROM {customer}"""

_BUILDS = """
SELECT s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'ament_cmake' WHEN 1 THEN 'ament_python' WHEN 2 THEN 'cmake' WHEN 3 THEN 'python' ELSE 'meta' END AS package_type,
  CASE WHEN s_suppkey % 3 > 0 THEN cast(s_suppkey % 101 AS INT) END AS health_score, concat('1.', s_suppkey % 12, '.0') AS version,
  concat('person ', s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ' <p@x.org>' END) AS maintainer, concat('pkg_', s_suppkey % 60) AS short_name FROM {supplier}"""

# Endpoints that grow with the documents: eight documents are a component, a source is a package, and texts of like length meet at a name.
_POSTS = """
SELECT concat('src_', coalesce(source, 'none')) AS package, concat('doc_', cast(floor(doc_id / 8) AS BIGINT)) AS component,
  CASE WHEN doc_id % 4 = 0 THEN 'publishes' WHEN doc_id % 4 = 1 THEN 'subscribes' WHEN doc_id % 4 = 2 THEN 'provides' ELSE 'calls' END AS role,
  concat('/', coalesce(lang, 'und'), '/n', n_chars % 997) AS name,
  CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE concat('msgs/T', n_chars % 3) END AS msg_type, doc_id AS seq
FROM {documents}"""

SQL = {"posts": _POSTS, "launch": _LAUNCH, "components": _COMPONENTS, "builds": _BUILDS, "endpoints": _ENDPOINTS, "deps": _DEPS, "chain": _CHAIN, "asked": _ASKED, "numbered": _NUMBERED, "signals": _SIGNALS, "packages": _PACKAGES, "interfaces": _INTERFACES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table over the Parquet files of sf_dir."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "lineitem", "orders", "customer", "supplier", "documents", "nation", "part", "pages")}
    return spark.sql(SQL[name].format(json="get_json_object(props, '$.k')", **tables))


def oracle(name: str) -> str:
    """The same as a DuckDB subquery."""
    names = {t: t for t in ("events", "lineitem", "orders", "customer", "supplier", "documents", "nation", "part", "pages")}
    return "(" + SQL[name].format(json="json_extract_string(props, '$.k')", **names) + ")"
