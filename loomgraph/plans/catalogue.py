"""Named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import assembly, graph, health, levels, packages, reach, rules
from .bridge import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


E, D, P, S, I, T, A, N, O = (oracle(n) for n in ("endpoints", "deps", "packages", "signals", "interfaces", "chain", "asked", "numbered", "posts"))
_REL = "CASE role WHEN 'serves' THEN 'provides' WHEN 'requests' THEN 'calls' ELSE role END"
_TOPIC, _SERVICE = "role IN ('publishes', 'subscribes')", "role IN ('provides', 'calls')"
_ID = f"CASE WHEN {_TOPIC} THEN concat('topic:', name) ELSE concat('svc:', name) END"
_NODE = "concat('node:', package, '/', component)"


def _sides(which: str, one: str, other: str) -> str:
    def side(rel: str) -> str:
        return f"coalesce(string_agg(component, ', ' ORDER BY seq) FILTER (role = '{rel}'), '') AS {rel}"

    known = "coalesce(min_by(msg_type, seq) FILTER (msg_type <> 'unknown'), 'unknown') AS msg_type"
    return f"(SELECT name, {known}, {side(one)}, {side(other)} FROM {E} WHERE {which} GROUP BY name)"


@_query(f"SELECT * FROM {_sides(_TOPIC, 'publishes', 'subscribes')}")
def topics(spark, d):
    return graph.peers(table(spark, d, "endpoints"), "Topic", "publishes", "subscribes")


@_query(f"SELECT * FROM {_sides(_SERVICE, 'provides', 'calls')}")
def services(spark, d):
    return graph.peers(table(spark, d, "endpoints"), "Service", "provides", "calls")


@_query(f"""
SELECT 'Topic' AS kind, count(DISTINCT name) AS n FROM {E} WHERE {_TOPIC} UNION ALL SELECT 'Service', count(DISTINCT name) FROM {E} WHERE {_SERVICE}
UNION ALL SELECT 'Node', count(DISTINCT component) FROM {E} UNION ALL SELECT 'Package', count(*) FROM {P}
UNION ALL SELECT 'Interface', count(*) FROM {I} UNION ALL SELECT 'Action', 0""")
def kind_summary(spark, d):
    return graph.kind_summary(*(table(spark, d, n) for n in ("endpoints", "packages", "interfaces")))


_EDGES = f"""(SELECT src, dst, rel, CASE WHEN r = 1 THEN rel ELSE concat(rel, '#', r) END AS key, seq FROM (
  SELECT {_NODE} AS src, {_ID} AS dst, {_REL} AS rel, seq, row_number() OVER (PARTITION BY package, component, {_ID}, role ORDER BY seq) AS r FROM {E}))"""


@_query(f"SELECT * FROM {_EDGES}")
def edge_keys(spark, d):
    return graph.comm_edges(table(spark, d, "endpoints"))


_TYPED = f"""(SELECT id, kind, name, coalesce(string_agg(msg_type, ', ' ORDER BY seq), '') AS observed, coalesce(min_by(msg_type, seq), 'unknown') AS msg_type FROM (
  SELECT {_ID} AS id, CASE WHEN {_TOPIC} THEN 'Topic' ELSE 'Service' END AS kind, name, nullif(msg_type, 'unknown') AS msg_type,
    CASE WHEN msg_type = 'unknown' THEN NULL ELSE min(seq) END AS seq FROM {E} GROUP BY {_ID}, {_TOPIC}, name, msg_type) GROUP BY id, kind, name)"""


@_query(f"SELECT id, msg_type FROM {_TYPED}")
def first_explicit_type(spark, d):
    return graph.comm_vertices(table(spark, d, "endpoints")).select("id", "msg_type")


@_query(f"SELECT id, observed FROM {_TYPED}")
def observed_types(spark, d):
    return graph.comm_vertices(table(spark, d, "endpoints")).select("id", F.array_join("observed_types", ", ").alias("observed"))


@_query(f"""SELECT id, first_type, msg_type, seq FROM (SELECT {_ID} AS id, msg_type, seq, first_value(msg_type) OVER w AS first_type, first_value(seq) OVER w AS fs
  FROM {E} WHERE msg_type <> 'unknown' WINDOW w AS (PARTITION BY {_ID} ORDER BY seq)) WHERE msg_type <> first_type""")
def type_conflicts(spark, d):
    return graph.type_conflicts(table(spark, d, "endpoints"))


@_query(f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY id")
def degree(spark, d):
    return graph.degree(graph.comm_edges(table(spark, d, "endpoints")))


@_query(f"""SELECT DISTINCT id FROM (SELECT 'node:pkg_3/user_3' AS id UNION ALL SELECT dst FROM {_EDGES} WHERE src = 'node:pkg_3/user_3'
  UNION ALL SELECT src FROM {_EDGES} WHERE dst = 'node:pkg_3/user_3')""")
def neighbours(spark, d):
    seed = spark.createDataFrame([("node:pkg_3/user_3",)], "id string")
    return graph.neighbourhood(graph.comm_edges(table(spark, d, "endpoints")), seed)


@_query(f"""WITH u AS (SELECT DISTINCT package, component, name, {_REL} AS rel FROM {E} WHERE {_TOPIC}), p AS (SELECT DISTINCT package, component, name FROM u)
SELECT u.package, u.component, u.name, u.rel, count(*) AS others FROM u JOIN p ON u.name = p.name AND (u.component <> p.component OR u.package <> p.package)
GROUP BY u.package, u.component, u.name, u.rel""")
def component_connections(spark, d):
    return graph.connections(table(spark, d, "endpoints"))


@_query(f"""SELECT {_ID} AS id, coalesce(min_by({_NODE}, seq) FILTER (role IN ('publishes', 'provides')), concat('pkg:', min_by(package, seq))) AS parent FROM {E} GROUP BY {_ID}""")
def compound_parents(spark, d):
    return graph.parents(table(spark, d, "endpoints"))


_CLOSURE = f"WITH RECURSIVE c AS (SELECT src, dst FROM {D} UNION SELECT c.src, d.dst FROM c JOIN {D} d ON c.dst = d.src)"


@_query(f"{_CLOSURE} SELECT src, dst FROM c")
def closure(spark, d):
    return graph.closure(table(spark, d, "deps"))


@_query(f"{_CLOSURE} SELECT src AS id FROM c WHERE src = dst")
def cyclic_members(spark, d):
    return graph.cyclic(table(spark, d, "deps"))


_CHAIN = f"WITH RECURSIVE d AS (SELECT DISTINCT src, dst FROM {T}), c AS (SELECT src, dst FROM d UNION SELECT c.src, d.dst FROM c JOIN d ON c.dst = d.src)"


@_query(f"{_CHAIN} SELECT DISTINCT src, dst FROM {A} JOIN c USING (src, dst)")
def reachable_pairs(spark, d):
    return reach.reachable(table(spark, d, "chain"), table(spark, d, "asked"))


@_query(f"{_CHAIN} SELECT x.src AS id, min(x.dst) AS component FROM c x JOIN c y ON y.src = x.dst AND y.dst = x.src GROUP BY x.src")
def strong_components(spark, d):
    return reach.strong_components(table(spark, d, "chain"))


_CYCLES = f"""WITH RECURSIVE d AS (SELECT DISTINCT src, dst FROM {T}), p AS (SELECT [src] AS path, dst FROM d UNION ALL
  SELECT list_append(p.path, p.dst), d.dst FROM p JOIN d ON d.src = p.dst WHERE p.dst > p.path[1] AND NOT list_contains(p.path, p.dst))"""


@_query(f"{_CYCLES} SELECT array_to_string(path, ' > ') AS cycle FROM p WHERE dst = path[1]")
def simple_cycles(spark, d):
    return reach.simple_cycles(table(spark, d, "chain")).select(F.array_join("cycle", " > ").alias("cycle"))


_TOPIC_RULE = f"""(SELECT 'warning' AS severity, 'topic_connectivity' AS rule_type, name AS entity, concat('Topic ''', name, ''' has no publisher; subscribers: ', subscribes) AS message
  FROM {_sides(_TOPIC, 'publishes', 'subscribes')} WHERE publishes = '' UNION ALL
  SELECT 'info', 'topic_connectivity', name, concat('Topic ''', name, ''' has no subscriber; publishers: ', publishes)
  FROM {_sides(_TOPIC, 'publishes', 'subscribes')} WHERE subscribes = '')"""
_SERVICE_RULE = f"""(SELECT 'info' AS severity, 'service_connectivity' AS rule_type, name AS entity, concat('Service ''', name, ''' is never called; provided by ', provides) AS message
  FROM {_sides(_SERVICE, 'provides', 'calls')} WHERE calls = '' UNION ALL
  SELECT 'warning', 'service_connectivity', name, concat('Service ''', name, ''' has no provider; called by ', calls)
  FROM {_sides(_SERVICE, 'provides', 'calls')} WHERE provides = '')"""


@_query(f"SELECT * FROM {_TOPIC_RULE}")
def rule_topic_connectivity(spark, d):
    return rules.topic_connectivity(table(spark, d, "endpoints"))


@_query(f"SELECT * FROM {_SERVICE_RULE}")
def rule_service_connectivity(spark, d):
    return rules.service_connectivity(table(spark, d, "endpoints"))


@_query(f"""SELECT 'warning' AS severity, 'node_isolation' AS rule_type, name AS entity, concat('Component ''', name, ''' has no connection') AS message
FROM (SELECT concat('pkg_', c_custkey % 7) AS package, concat('user_', c_custkey) AS name FROM customer) n
WHERE NOT EXISTS (SELECT 1 FROM {E} e WHERE e.package = n.package AND e.component = n.name)""")
def rule_node_isolation(spark, d):
    nodes = spark.read.parquet(f"{d}/customer.parquet").selectExpr("concat('pkg_', c_custkey % 7) AS package", "concat('user_', c_custkey) AS name", "false AS has_dynamic_names")
    return rules.node_isolation(nodes, table(spark, d, "endpoints"))


@_query(f"""SELECT 'error' AS severity, 'license' AS rule_type, name AS entity, CASE WHEN coalesce(license, '') = '' THEN concat('Package ''', name, ''' has no license')
  ELSE concat('Package ''', name, ''' has license ', license) END AS message FROM {P} WHERE coalesce(license, '') = '' OR license <> 'License-1'""")
def rule_license(spark, d):
    return rules.license_rule(table(spark, d, "packages"), ["License-1"])


@_query(f"""SELECT 'info' AS severity, 'version_not_default' AS rule_type, name AS entity, concat('Package ''', name, ''' has the default version') AS message FROM {P} WHERE version = '0.0.0'""")
def rule_version_default(spark, d):
    return rules.version_not_default(table(spark, d, "packages"))


@_query(f"""SELECT 'warning' AS severity, 'naming' AS rule_type, name AS entity, concat('Name ''', name, ''' does not match') AS message FROM (SELECT label AS name FROM {P}) WHERE NOT regexp_matches(name, '^(?:[A-Z]+_?1)')""")
def rule_naming(spark, d):
    return rules.naming(table(spark, d, "packages").select(F.col("label").alias("name")), "[A-Z]+_?1")


_FORBIDDEN = "(SELECT * FROM (VALUES ('nation_1', 'nation_2'), ('nation_3', 'nation_3'), ('nation_0', 'nation_99')) t(src, dst))"
_REACH = f"{_CLOSURE}, r AS (SELECT src, dst FROM c UNION SELECT name, name FROM {P})"
_PAIRS = [("nation_1", "nation_2"), ("nation_3", "nation_3"), ("nation_0", "nation_99")]


@_query(f"""{_REACH} SELECT 'error' AS severity, 'dependency' AS rule_type, f.src AS entity, concat('''', f.src, ''' must not depend on ''', f.dst, '''') AS message
FROM {_FORBIDDEN} f JOIN r ON r.src = f.src AND r.dst = f.dst""")
def rule_dependency_forbidden(spark, d):
    return rules.dependency_forbidden(table(spark, d, "deps"), table(spark, d, "packages"), _PAIRS)


@_query(f"""{_REACH} SELECT 'warning' AS severity, 'dependency' AS rule_type, f.src AS entity, concat('''', f.src, ''' must depend on ''', f.dst, '''') AS message
FROM {_FORBIDDEN} f WHERE f.src IN (SELECT name FROM {P}) AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = f.src AND r.dst = f.dst)""")
def rule_dependency_required(spark, d):
    return rules.dependency_required(table(spark, d, "deps"), table(spark, d, "packages"), _PAIRS)


_FAR = [(f"doc_{a:09d}", f"doc_{b:09d}") for a, b in ((990, 1), (900, 3), (150, 1), (7, 900), (5, 5), (999_999_999, 1), (600, 601))]
_FAR_SQL = f"(SELECT * FROM (VALUES {', '.join(map(str, _FAR))}) t(src, dst))"


@_query(f"""{_CHAIN}, r AS (SELECT src, dst FROM c UNION SELECT name, name FROM {N})
SELECT 'error' AS severity, 'dependency' AS rule_type, f.src AS entity, concat('''', f.src, ''' must not depend on ''', f.dst, '''') AS message
FROM {_FAR_SQL} f JOIN r ON r.src = f.src AND r.dst = f.dst
UNION ALL SELECT 'warning', 'dependency', f.src, concat('''', f.src, ''' must depend on ''', f.dst, '''')
FROM {_FAR_SQL} f WHERE f.src IN (SELECT name FROM {N}) AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = f.src AND r.dst = f.dst)""")
def rule_dependency_chain(spark, d):
    deps, known = table(spark, d, "chain"), table(spark, d, "numbered")
    return rules.dependency_forbidden(deps, known, _FAR).unionByName(rules.dependency_required(deps, known, _FAR))


_SCORE = "least(100, 10 + " + " + ".join(f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in health.WEIGHTS.items() if n != "no_circular_deps") + ")"


@_query(f"SELECT name, cast({_SCORE} AS INTEGER) AS score FROM {S}")
def health_score(spark, d):
    return health.score(table(spark, d, "signals"))


@_query(f"SELECT cast(coalesce(round_even(avg({_SCORE}), 0), 0) AS BIGINT) AS score FROM {S}")
def workspace_score(spark, d):
    return health.workspace_score(health.score(table(spark, d, "signals")))


@_query(f"SELECT 'warning' AS severity, 'health_threshold' AS rule_type, name AS entity, concat('Package ''', name, ''' scores ', cast({_SCORE} AS INTEGER)) AS message FROM {S} WHERE {_SCORE} < 95")
def rule_health_threshold(spark, d):
    return rules.health_threshold(health.score(table(spark, d, "signals")), 95)


def _all_findings(spark, d):
    e = table(spark, d, "endpoints")
    return rules.topic_connectivity(e).unionByName(rules.service_connectivity(e))


_FINDINGS = f"(SELECT * FROM {_TOPIC_RULE} UNION ALL SELECT * FROM {_SERVICE_RULE})"


@_query(f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM {_FINDINGS}")
def violation_summary(spark, d):
    return rules.violation_summary(_all_findings(spark, d))


@_query(f"SELECT rule_type, count(*) AS n FROM {_FINDINGS} GROUP BY rule_type")
def findings_by_rule(spark, d):
    return rules.findings_by_rule(_all_findings(spark, d))


@_query("""SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(x, '([A-Za-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]', '_', 'g')), '_') AS symbol
FROM (SELECT p_partkey, concat('HTTPServer ', p_name, ' ', p_brand) AS x FROM part)""")
def symbol_normalise(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("HTTPServer "), "p_name", F.lit(" "), "p_brand").alias("x"))
    return part.select("p_partkey", names.snake_symbol(F.col("x")).alias("symbol"))


@_query(f"""SELECT id, concat(regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g'), '_', left(sha1(id), 8), CASE kind WHEN 'Topic' THEN '(["' ELSE '{{{{"' END, replace(name, '"', ''''),
  CASE kind WHEN 'Topic' THEN '"])' ELSE '"}}}}' END) AS line FROM {_TYPED}""")
def mermaid_lines(spark, d):
    return graph.mermaid_vertices(graph.comm_vertices(table(spark, d, "endpoints")), names.slug)


@_query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '' AND l <> '---' AND NOT starts_with(l, '#')), ' / ') AS fields FROM documents""")
def interface_fields(spark, d):
    from ..sources.workspace import field_lines

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(field_lines(F.col("text")), " / ").alias("fields"))


L, C, B = (oracle(n) for n in ("launch", "components", "builds"))


def _launch_nodes(spark, d):
    return table(spark, d, "launch").withColumn("remaps", F.create_map("remap_from", "remap_to"))


_MATCHED = f"""(SELECT package, component, deployment_name, namespace FROM (
  SELECT c.package, c.name AS component, coalesce(l.name, l.executable) AS deployment_name, l.namespace, row_number() OVER (PARTITION BY c.package, c.name ORDER BY l.seq) AS r
  FROM {C} c JOIN {L} l ON l.owner_package = c.package AND (l.name = c.name OR l.executable = c.name)) WHERE r = 1)"""


@_query(f"SELECT * FROM {_MATCHED}")
def launch_match(spark, d):
    return assembly.match_launch(table(spark, d, "components"), _launch_nodes(spark, d)).drop("remaps")


@_query(f"""SELECT package, component, role, seq, original_name, CASE WHEN namespace IS NULL OR starts_with(r, '/') THEN r ELSE concat('/', namespace, '/', r) END AS name,
  CASE WHEN namespace IS NULL OR starts_with(r, '/') THEN r ELSE concat('/', namespace, '/', r) END <> original_name AS remapped FROM (
  SELECT e.package, e.component, e.role, e.seq, e.n AS original_name, l.namespace,
    CASE WHEN l.remap_from = e.n OR l.remap_from = concat('/', e.n) THEN l.remap_to ELSE e.n END AS r
  FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN substring(name, 2) ELSE name END AS n FROM {E}) e LEFT JOIN {L} l ON l.owner_package = e.package AND l.executable = e.component)""")
def effective_names(spark, d):
    declared = table(spark, d, "endpoints").withColumn("name", F.expr("if(seq % 2 = 0, substring(name, 2), name)")).drop("msg_type")
    return assembly.effective_endpoints(declared, assembly.match_launch(table(spark, d, "components"), _launch_nodes(spark, d)))


_GUESSED = f"""(SELECT v.id, v.name, CASE WHEN v.msg_type = 'unknown' THEN coalesce(o.t, 'unknown') ELSE v.msg_type END AS msg_type,
  CASE WHEN v.msg_type <> 'unknown' THEN 'explicit' WHEN o.t IS NULL THEN 'unknown' ELSE 'inferred_name_match' END AS type_source,
  CASE WHEN v.msg_type = 'unknown' THEN 'low' ELSE 'high' END AS confidence FROM {_TYPED} v
  LEFT JOIN (SELECT lower(name) AS bare, min(concat(package, '/', name)) AS t FROM {I} GROUP BY lower(name) HAVING count(*) = 1) o ON o.bare = lower(regexp_extract(v.name, '[^/]*$')))"""


def _typed(spark, d):
    return assembly.infer_types(graph.comm_vertices(table(spark, d, "endpoints")), table(spark, d, "interfaces"))


@_query(f"SELECT id, msg_type, type_source, confidence FROM {_GUESSED}")
def inferred_types(spark, d):
    return _typed(spark, d).select("id", "msg_type", "type_source", "confidence")


@_query(f"SELECT e.src, concat('iface:', g.msg_type) AS dst, min(e.seq) AS seq FROM {_EDGES} e JOIN {_GUESSED} g ON g.id = e.dst WHERE g.msg_type IN (SELECT concat(package, '/', name) FROM {I}) GROUP BY e.src, g.msg_type")
def uses_interface(spark, d):
    return assembly.uses_interface(graph.comm_edges(table(spark, d, "endpoints")), _typed(spark, d), table(spark, d, "interfaces")).select("src", "dst", "seq")


@_query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM {_EDGES} GROUP BY least(src, dst), greatest(src, dst)")
def edge_bundles(spark, d):
    return graph.edge_bundles(graph.comm_edges(table(spark, d, "endpoints")))


@_query(f"SELECT concat('pkg:', src) AS src, concat('pkg:', dst) AS dst, 'depends_on' AS key FROM {D} WHERE dst IN (SELECT name FROM {P})")
def subgraph_deps(spark, d):
    pkgs = table(spark, d, "packages")
    vertices = pkgs.select(F.concat(F.lit("pkg:"), "name").alias("id"), F.lit("Package").alias("kind"), "name", F.col("name").alias("package"))
    deps = table(spark, d, "deps").select(F.concat(F.lit("pkg:"), "src").alias("src"), F.concat(F.lit("pkg:"), "dst").alias("dst"), F.lit("depends_on").alias("rel"), F.lit(0).alias("seq"))
    return graph.subgraph(vertices, graph.keyed(deps), "deps")[1].select("src", "dst", "key")


_NAMED = f"(SELECT DISTINCT {_NODE} AS id, component AS name, package FROM {E} UNION SELECT DISTINCT {_ID}, name, NULL FROM {E})"


def _named(spark, d):
    e = table(spark, d, "endpoints")
    nodes = graph.components(e).select("id", F.col("component").alias("name"), "package")
    return nodes.unionByName(graph.comm_vertices(e).select("id", "name", F.lit(None).cast("string").alias("package")))


def _focus_sql(seed: str) -> str:
    near = f"(SELECT id FROM {_NAMED} WHERE {seed} UNION SELECT dst FROM {_EDGES} WHERE src IN (SELECT id FROM {_NAMED} WHERE {seed}) UNION SELECT src FROM {_EDGES} WHERE dst IN (SELECT id FROM {_NAMED} WHERE {seed}))"
    return f"SELECT src, dst, key FROM {_EDGES} WHERE src IN {near} AND dst IN {near}"


@_query(_focus_sql("package = 'pkg_3'"))
def package_focus(spark, d):
    return graph.focus(_named(spark, d), graph.comm_edges(table(spark, d, "endpoints")), "pkg_3")[1].select("src", "dst", "key")


@_query(f"""SELECT id, bool_or(hit) AS hit FROM (SELECT id, true AS hit FROM {_NAMED} WHERE contains(lower(name), 'k7') UNION ALL
  SELECT e.src, false FROM {_EDGES} e JOIN {_NAMED} v ON v.id = e.dst WHERE contains(lower(v.name), 'k7') UNION ALL
  SELECT e.dst, false FROM {_EDGES} e JOIN {_NAMED} v ON v.id = e.src WHERE contains(lower(v.name), 'k7')) GROUP BY id""")
def label_search(spark, d):
    return graph.label_search(_named(spark, d), graph.comm_edges(table(spark, d, "endpoints")), "K7")


_PARENT = f"(SELECT {_ID} AS id, coalesce(min_by(package, seq) FILTER (role IN ('publishes', 'provides')), min_by(package, seq)) AS package FROM {E} GROUP BY {_ID})"


@_query(f"SELECT e.src, e.dst, e.key FROM {_EDGES} e JOIN {_PARENT} p ON p.id = e.dst WHERE regexp_extract(e.src, '^node:([^/]*)', 1) <> p.package")
def cross_package_edges(spark, d):
    e = table(spark, d, "endpoints")
    of = F.regexp_extract("parent", "^(?:node|pkg):([^/]*)", 1)
    owners = graph.components(e).select("id", "package").unionAll(graph.parents(e).select("id", of))
    return graph.cross_package_edges(graph.comm_edges(e), owners)


_ACTION_ROLE = "CASE role WHEN 'provides' THEN 'serves' WHEN 'calls' THEN 'requests' ELSE role END"


@_query(f"""SELECT 'warning' AS severity, 'action_connectivity' AS rule_type, name AS entity, concat('Action ''', name, ''' is never called; provided by ', provides) AS message
  FROM {_sides(_SERVICE, 'provides', 'calls')} WHERE calls = '' UNION ALL
  SELECT 'warning', 'action_connectivity', name, concat('Action ''', name, ''' has no provider; called by ', calls) FROM {_sides(_SERVICE, 'provides', 'calls')} WHERE provides = ''""")
def rule_action_connectivity(spark, d):
    return rules.service_connectivity(table(spark, d, "endpoints").withColumn("role", F.expr(_ACTION_ROLE)), "Action", "warning", "warning")


@_query(f"SELECT 'warning' AS severity, 'maintainer_required' AS rule_type, name AS entity, concat('Package ''', name, ''' has no maintainer') AS message FROM {B} WHERE NOT contains(maintainer, '@')")
def rule_maintainer(spark, d):
    return rules.maintainer_required(table(spark, d, "builds").withColumn("maintainers", F.array("maintainer")), True)


@_query(f"""{_CYCLES} SELECT 'error' AS severity, 'no_circular_deps' AS rule_type, path[1] AS entity, concat('Dependency cycle: ', array_to_string(path, ' > ')) AS message FROM p WHERE dst = path[1]""")
def rule_no_circular(spark, d):
    return rules.no_circular_deps(table(spark, d, "chain"))


@_query(f"SELECT name, package_type, health_score FROM {B} WHERE package_type IN ('ament_cmake', 'cmake') ORDER BY coalesce(health_score, 0) DESC, name")
def packages_filter_sort(spark, d):
    return packages.listed(table(spark, d, "builds"), "cpp", "health").select("name", "package_type", "health_score")


@_query(f"SELECT short_name AS name, string_agg(name, ', ' ORDER BY name) AS paths FROM {B} GROUP BY short_name HAVING count(*) > 1")
def duplicate_packages(spark, d):
    rows = table(spark, d, "builds").select(F.col("short_name").alias("name"), F.col("name").alias("path"))
    return assembly.duplicate_packages(rows).select("name", F.array_join("paths", ", ").alias("paths"))


@_query(f"""SELECT src, dst, key, concat(regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g'), '_', left(sha1(src), 8), ' -> ', regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g'), '_', left(sha1(dst), 8),
  ' [label="', rel, '"];') AS line FROM {_EDGES}""")
def dot_lines(spark, d):
    return graph.dot_edges(graph.comm_edges(table(spark, d, "endpoints")), names.slug)


@_query(f"SELECT bool_or(severity IN ('error', 'warning')) AS fails FROM {_FINDINGS}")
def exit_gate(spark, d):
    return _all_findings(spark, d).agg(F.bool_or(names.severity_rank(F.col("severity")) <= 1).alias("fails"))



_ACTIONS = f"(SELECT name, msg_type, provides, calls FROM {_sides(_SERVICE, 'provides', 'calls')})"


@_query(f"SELECT * FROM {_ACTIONS}")
def actions(spark, d):
    return graph.peers(table(spark, d, "endpoints").withColumn("role", F.expr(_ACTION_ROLE)), "Action", "provides", "calls")


@_query(f"SELECT owner_package, executable, coalesce(name, '') AS name, remap_from, remap_to FROM {L}")
def launch_remaps(spark, d):
    return assembly.launch_remaps(_launch_nodes(spark, d)).drop("seq")


@_query(f"""SELECT DISTINCT name, CASE WHEN len(string_split(ltrim(name, '/'), '/')) > 2
  THEN concat('/', array_to_string(list_slice(string_split(ltrim(name, '/'), '/'), -2, -1), '/')) ELSE name END AS label
  FROM (SELECT CASE WHEN seq % 2 = 0 THEN concat('/fleet', name) ELSE name END AS name FROM {E} WHERE {_TOPIC})""")
def short_labels(spark, d):
    rows = table(spark, d, "endpoints").filter("role IN ('publishes', 'subscribes')").select(F.expr("if(seq % 2 = 0, concat('/fleet', name), name)").alias("name")).distinct()
    return rows.select("name", names.short_label(F.lit("Topic"), F.col("name")).alias("label"))


@_query(f"""{_CHAIN} SELECT name, cast(greatest(0, score - CASE WHEN name IN (SELECT src FROM c WHERE src = dst) THEN 10 ELSE 0 END) AS INTEGER) AS score FROM {N}""")
def health_with_cycles(spark, d):
    return health.deduct_cycles(table(spark, d, "numbered"), table(spark, d, "chain"))


_KIND = f"CASE WHEN {_TOPIC} THEN 'Topic' ELSE 'Service' END"


@_query(f"""SELECT m.package, m.component, {_KIND.replace('role', 'm.role')} AS kind, m.name, {_REL.replace('role', 'm.role')} AS role, m.msg_type, m.seq,
  p.role AS peer_rel, p.package AS peer_package, p.component AS peer_component, p.seq AS peer_seq
  FROM (SELECT * FROM {E} WHERE package = 'pkg_3') m LEFT JOIN {E} p ON p.name = m.name AND (p.role IN ('publishes', 'subscribes')) = (m.role IN ('publishes', 'subscribes'))
    AND p.role <> 'provides' AND (p.package <> m.package OR p.component <> m.component)""")
def node_connections(spark, d):
    e = table(spark, d, "endpoints")
    return graph.connection_rows(e, e.filter("package = 'pkg_3'"))


_HOME = f"coalesce(min_by({_NODE}, seq) FILTER (role IN ('publishes', 'provides')), concat('pkg:', min_by(package, seq)))"
_SHORT = "CASE WHEN len(string_split(ltrim(name, '/'), '/')) > 2 THEN concat('/', array_to_string(list_slice(string_split(ltrim(name, '/'), '/'), -2, -1), '/')) ELSE name END"


@_query(f"""SELECT {_ID} AS id, {_KIND} AS kind, name, {_SHORT} AS label, {_HOME} AS parent FROM {E} GROUP BY {_ID}, {_KIND}, name
  UNION ALL SELECT DISTINCT {_NODE}, 'Node', component, component, concat('pkg:', package) FROM {E}
  UNION ALL SELECT DISTINCT concat('pkg:', package), 'Package', package, package, NULL FROM {E}""")
def compound_elements(spark, d):
    e = table(spark, d, "endpoints")
    nodes = graph.components(e).select("id", F.lit("Node").alias("kind"), F.col("component").alias("name"), "package")
    vertices = nodes.unionByName(graph.comm_vertices(e).select("id", "kind", "name", F.lit(None).cast("string").alias("package")))
    return graph.compound(vertices, graph.comm_edges(e))[0]


@_query(f"SELECT src, dst, key FROM {_EDGES}")
def subgraph_comms(spark, d):
    e = table(spark, d, "endpoints")
    nodes = graph.components(e).select("id", F.lit("Node").alias("kind"))
    vertices = nodes.unionByName(graph.comm_vertices(e).select("id", "kind")).unionByName(table(spark, d, "packages").select(F.concat(F.lit("pkg:"), "name").alias("id"), F.lit("Package").alias("kind")))
    return graph.subgraph(vertices, graph.comm_edges(e), "comms")[1].select("src", "dst", "key")


def _tree_sql(levels: int, fan: int = 64) -> str:
    """The digest tree over the documents of a language, with as many levels above the lowest."""
    sql = f"""SELECT lang AS package, (nth - 1) // {fan} + 1 AS nth, sha256(string_agg(line, chr(10) ORDER BY nth)) AS digest FROM (
      SELECT lang, concat(path, ' ', sha256(coalesce(text, ''))) AS line, row_number() OVER (PARTITION BY lang ORDER BY path) AS nth
      FROM (SELECT lang, text, lpad(cast(doc_id AS VARCHAR), 12, '0') AS path FROM documents)) GROUP BY lang, (nth - 1) // {fan}"""
    for _ in range(levels):
        sql = f"""SELECT package, (nth - 1) // {fan} + 1 AS nth, CASE WHEN max(nth) = 1 THEN max(digest) ELSE sha256(string_agg(digest, chr(10) ORDER BY nth)) END AS digest
      FROM ({sql}) GROUP BY package, (nth - 1) // {fan}"""
    return f"SELECT package, digest AS fingerprint FROM ({sql})"


@_query(_tree_sql(4))
def content_fingerprint(spark, d):
    from ..sources.workspace import fingerprints_of

    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return fingerprints_of(docs.select(F.col("lang").alias("package"), path.alias("rel_path"), F.coalesce("text", F.lit("")).alias("text")))


_KIND_OF = "CASE WHEN role IN ('publishes', 'subscribes') THEN 'Topic' ELSE 'Service' END"


@_query(f"""SELECT kind, name, rel, (nth - 1) // 2 AS chunk, (nth - 1) // 2 * 2 + 1 AS first, string_agg(component, ', ' ORDER BY nth) AS components FROM (
  SELECT {_KIND_OF} AS kind, name, {_REL} AS rel, component, row_number() OVER (PARTITION BY name, role ORDER BY seq) AS nth FROM {E}) GROUP BY kind, name, rel, (nth - 1) // 2""")
def peer_chunks(spark, d):
    return graph.peer_chunks(table(spark, d, "endpoints"), 2).withColumn("components", F.array_join("components", ", "))


@_query(f"""WITH e AS (SELECT *, {_KIND_OF} AS kind, {_REL} AS rel FROM {E})
SELECT m.package, m.component, m.kind, m.name, m.rel AS role, m.msg_type, m.seq,
  (SELECT count(*) FROM e p WHERE p.name = m.name AND p.kind = m.kind AND p.role <> 'provides' AND (p.package <> m.package OR p.component <> m.component)) AS others FROM e m""")
def connection_members(spark, d):
    return graph.connection_members(table(spark, d, "endpoints"))


@_query(f"""SELECT package, component, role, name, seq, CASE WHEN msg_type <> 'unknown' THEN 'explicit' ELSE 'unknown' END AS type_source,
  CASE WHEN msg_type <> 'unknown' AND name <> '<dynamic>' THEN 'high' ELSE 'low' END AS confidence
  FROM (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN '<dynamic>' ELSE name END AS name) FROM {E})""")
def endpoint_confidence(spark, d):
    rows = table(spark, d, "endpoints").withColumn("name", F.expr("if(seq % 5 = 0, '<dynamic>', name)"))
    return assembly.with_confidence(rows).drop("msg_type")


@_query(f"SELECT name, concat(repeat('█', n), repeat('░', 10 - n)) AS bar, CASE WHEN s >= 70 THEN 'green' WHEN s >= 40 THEN 'yellow' ELSE 'red' END AS colour FROM (SELECT name, coalesce(health_score, 0) AS s, cast(greatest(0, least(10, round_even(coalesce(health_score, 0) / 10.0, 0))) AS INTEGER) AS n FROM {B})")
def health_bars(spark, d):
    score = F.coalesce("health_score", F.lit(0))
    return table(spark, d, "builds").select("name", names.health_bar(score).alias("bar"), names.health_colour(score).alias("colour"))


_LIST = "coalesce(string_agg(name, ', ' ORDER BY seq) FILTER (role = '{}'), '—') AS {}"


@_query(f"""SELECT concat(component, CASE WHEN bool_or(name = '<dynamic>') THEN ' (dynamic)' ELSE '' END) AS name, package, 'python' AS language,
  {', '.join(_LIST.format(r, r) for r in ('publishes', 'subscribes', 'provides', 'calls'))}, '—' AS serves, '—' AS requests
  FROM (SELECT * REPLACE (CASE WHEN seq % 50 = 0 THEN '<dynamic>' ELSE name END AS name) FROM {E}) GROUP BY package, component""")
def node_table(spark, d):
    rows = table(spark, d, "endpoints").withColumn("name", F.expr("if(seq % 50 = 0, '<dynamic>', name)"))
    nodes = rows.groupBy("package", F.col("component").alias("name")).agg(F.bool_or(F.col("name") == "<dynamic>").alias("has_dynamic_names"))
    return packages.node_table(nodes.withColumn("language", F.lit("python")), rows)


_RAW = "CASE p_partkey % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'Warning' WHEN 2 THEN 'info' WHEN 3 THEN 'fatal' END"


@_query(f"SELECT p_partkey, CASE WHEN lower(raw) IN ('error', 'warning', 'info') THEN lower(raw) ELSE 'warning' END AS severity FROM (SELECT p_partkey, {_RAW} AS raw FROM part)")
def severity_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_RAW).alias("raw"))
    return part.select("p_partkey", names.severity(F.col("raw")).alias("severity"))


@_query(f"""SELECT 'vertices' AS part, kind AS what, count(*) AS n FROM (SELECT DISTINCT {_ID} AS id, {_KIND} AS kind FROM {E} WHERE {_TOPIC} UNION SELECT DISTINCT {_NODE}, 'Node' FROM {E}) GROUP BY kind
  UNION ALL SELECT 'edges', rel, count(*) FROM {_EDGES} WHERE rel = 'publishes' GROUP BY rel""")
def visible_counts(spark, d):
    e = table(spark, d, "endpoints")
    vertices = graph.components(e).select("id", F.lit("Node").alias("kind")).unionByName(graph.comm_vertices(e).select("id", "kind"))
    return graph.visible_counts(vertices, graph.comm_edges(e), ["Service"], ["subscribes"])


_ONE = "node:pkg_3/user_3"


@_query(f"""WITH near AS (SELECT '{_ONE}' AS id UNION SELECT dst FROM {_EDGES} WHERE src = '{_ONE}' UNION SELECT src FROM {_EDGES} WHERE dst = '{_ONE}'),
  up AS (SELECT {_ID} AS id, {_HOME} AS parent FROM {E} GROUP BY {_ID} UNION SELECT DISTINCT {_NODE}, concat('pkg:', package) FROM {E}),
  one AS (SELECT up.parent AS id FROM near JOIN up USING (id))
  SELECT id FROM near UNION SELECT id FROM one UNION SELECT up.parent FROM one JOIN up USING (id)""")
def selection(spark, d):
    e = table(spark, d, "endpoints")
    nodes = graph.components(e).select("id", F.lit("Node").alias("kind"), F.col("component").alias("name"), "package")
    vertices = nodes.unionByName(graph.comm_vertices(e).select("id", "kind", "name", F.lit(None).cast("string").alias("package")))
    edges = graph.comm_edges(e)
    return graph.selection(graph.compound(vertices, edges)[0], edges, spark.createDataFrame([(_ONE,)], "id string"))


def _nested(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = graph.components(endpoints).select("id", F.lit("Node").alias("kind"), F.col("component").alias("name"), "package")
    vertices = nodes.unionByName(graph.comm_vertices(endpoints).select("id", "kind", "name", F.lit(None).cast("string").alias("package")))
    return graph.compound(vertices, graph.comm_edges(endpoints))


_LEVELS = f"""WITH el AS ({ORACLE["compound_elements"].replace(E, O)}),
  path AS (SELECT a.*, list_filter([c.id, b.id, a.id], lambda x: x IS NOT NULL) AS path FROM el a LEFT JOIN el b ON b.id = a.parent LEFT JOIN el c ON c.id = b.parent)"""


@_query(f"""{_LEVELS} SELECT p.parent AS container, p.id, p.kind, p.name, p.label, (SELECT count(*) FROM path q WHERE q.id <> p.id AND list_contains(q.path, p.id)) AS inside FROM path p""")
def level_elements(spark, d):
    return levels.level_elements(_nested(table(spark, d, "posts"))[0])


@_query(f"""{_LEVELS}, met AS (SELECT e.src, e.dst, e.rel, s.path AS a, t.path AS b, len(list_intersect(s.path, t.path)) AS k
    FROM {_EDGES.replace(E, O)} e JOIN path s ON s.id = e.src JOIN path t ON t.id = e.dst)
  SELECT CASE WHEN k > 0 THEN a[k] END AS container, coalesce(a[k + 1], src) AS src, coalesce(b[k + 1], dst) AS dst, rel, count(*) AS n FROM met GROUP BY ALL""")
def level_edges(spark, d):
    return levels.level_edges(*_nested(table(spark, d, "posts")))


@_query(f"SELECT * FROM {_TOPIC_RULE}".replace(E, O))
def document_topic_connectivity(spark, d):
    return rules.topic_connectivity(table(spark, d, "posts"))


@_query(ORACLE["component_connections"].replace(E, O))
def document_connections(spark, d):
    return graph.connections(table(spark, d, "posts"))
