"""The architecture graph as two tables, vertices and edges, and queries over them.

endpoints: (package, component, role, name, msg_type, seq). seq is the order in which endpoints
are seen; whatever the first one decides is decided by the least seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import UNKNOWN, short_label
from ..shared import drop, save
from .numbering import CROWDED, chunked, numbered
from .reach import strong_components

#: role: (relation, kind of the vertex it points at, prefix of its id)
ROLES = {
    "publishes": ("publishes", "Topic", "topic:"),
    "subscribes": ("subscribes", "Topic", "topic:"),
    "provides": ("provides", "Service", "svc:"),
    "calls": ("calls", "Service", "svc:"),
    "serves": ("provides", "Action", "action:"),
    "requests": ("calls", "Action", "action:"),
}
COMM_RELATIONS = ("publishes", "subscribes", "provides", "calls")


def _by_role(part: int) -> Column:
    out = F.lit(None).cast("string")
    for role, facts in ROLES.items():
        out = F.when(F.col("role") == role, facts[part]).otherwise(out)
    return out


def node_id() -> Column:
    return F.concat(F.lit("node:"), "package", F.lit("/"), "component")


def comm_edges(endpoints: DataFrame) -> DataFrame:
    """(src, dst, rel, key, seq): parallel edges are numbered rel, rel#2, ... in the order seen."""
    edges = endpoints.select(node_id().alias("src"), F.concat(_by_role(2), "name").alias("dst"), _by_role(0).alias("rel"), "seq")
    return keyed(edges)


def keyed(edges: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(src, dst, rel, key, seq): adds the key of edges (src, dst, rel, seq), which is rel, rel#2, ... among those of one source, target and relation."""
    key = F.when(F.col("nth") == 1, F.col("rel")).otherwise(F.concat("rel", F.lit("#"), "nth")).alias("key")
    return numbered(edges, ["src", "dst", "rel"], ["seq"], "nth", crowded).select("src", "dst", "rel", key, "seq")


def comm_vertices(endpoints: DataFrame) -> DataFrame:
    """(id, kind, name, msg_type, observed_types): the type is the first explicit one; observed ones in the order first seen."""
    seen = endpoints.select(F.concat(_by_role(2), "name").alias("id"), _by_role(1).alias("kind"), "name", "msg_type", "seq")
    types = seen.groupBy("id", "kind", "name", "msg_type").agg(F.min("seq").alias("seq"))
    explicit = F.when(F.col("msg_type") != UNKNOWN, F.struct("seq", "msg_type"))
    return types.groupBy("id", "kind", "name").agg(F.sort_array(F.collect_list(explicit)).alias("t")).select(
        "id", "kind", "name", F.coalesce(F.get("t", F.lit(0))["msg_type"], F.lit(UNKNOWN)).alias("msg_type"), F.col("t.msg_type").alias("observed_types")
    )


def type_conflicts(endpoints: DataFrame) -> DataFrame:
    """(id, first_type, msg_type, seq): each later explicit type that differs from the first one."""
    known = endpoints.filter(F.col("msg_type") != UNKNOWN).select(F.concat(_by_role(2), "name").alias("id"), "msg_type", "seq")
    first = known.groupBy("id").agg(F.min(F.struct("seq", "msg_type")).alias("f"))
    return known.join(first, "id").filter("msg_type <> f.msg_type AND seq > f.seq").select("id", F.col("f.msg_type").alias("first_type"), "msg_type", "seq")


def components(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("package", "component").agg(F.min("seq").alias("seq")).withColumn("id", node_id())


def _of_kind(endpoints: DataFrame, kind: str) -> DataFrame:
    return endpoints.withColumns({"rel": _by_role(0), "kind": _by_role(1)}).filter(F.col("kind") == kind)


def _side(rel: str) -> Column:
    rows = F.sort_array(F.collect_list(F.when(F.col("rel") == rel, F.struct("seq", "component"))))
    return F.array_join(F.transform(rows, lambda r: r["component"]), ", ").alias(rel)


def peers(endpoints: DataFrame, kind: str, one: str, other: str) -> DataFrame:
    """(name, msg_type, <one>, <other>): per topic, service or action its type and its components on either side, in the order seen.

    The lists are as long as a name is crowded; peer_rows() has the same as rows.
    """
    known = F.min_by("msg_type", F.when(F.col("msg_type") != UNKNOWN, F.col("seq")))
    return _of_kind(endpoints, kind).groupBy("name").agg(F.coalesce(known, F.lit(UNKNOWN)).alias("msg_type"), _side(one), _side(other))


def peer_rows(endpoints: DataFrame) -> DataFrame:
    """(kind, name, rel, package, component, seq): who is at each topic, service and action, a row for each endpoint."""
    return endpoints.select(_by_role(1).alias("kind"), "name", _by_role(0).alias("rel"), "package", "component", "seq")


def peer_chunks(endpoints: DataFrame, size: int = 1000, crowded: int = CROWDED) -> DataFrame:
    """(kind, name, rel, chunk, first, components): who is at each side of each topic, service and action, in the order seen.

    A list has `size` components at most and begins with the number `first` of its side; a crowded name has many lists, which
    many tasks make.
    """
    rows = peer_rows(endpoints)
    return chunked(rows, ["kind", "name", "rel"], ["seq"], F.col("component"), size, crowded).withColumnRenamed("items", "components")


def connection_members(endpoints: DataFrame) -> DataFrame:
    """(package, component, kind, name, role, msg_type, seq, others): each endpoint, with the number of endpoints of others that it meets.

    With peer_chunks() this is the factorised form of connection_rows(): who is at a name stands once for the name, and who reads the connections
    of a component takes the lists of its names, without its own. Both tables are of the size of the endpoints, not of their pairs.
    At topics the others are publishers and subscribers, at services and actions callers.
    """
    there = peer_rows(endpoints).filter("kind = 'Topic' OR rel = 'calls'")
    own = there.groupBy("kind", "name", "package", "component").agg(F.count("*").alias("_own"))
    whole = own.groupBy("kind", "name").agg(F.sum("_own").alias("_all"))
    mine = endpoints.select("package", "component", _by_role(1).alias("kind"), "name", _by_role(0).alias("role"), "msg_type", "seq")
    joined = mine.join(whole, ["kind", "name"], "left").join(own, ["kind", "name", "package", "component"], "left")
    others = F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return joined.select("package", "component", "kind", "name", "role", "msg_type", "seq", others.alias("others"))


#: Components that a finding's message names at most; peer_chunks() has all.
NAMED = 1000


def lacking(endpoints: DataFrame, kind: str, missing: str, there: str) -> DataFrame:
    """(name, <there>): the topics or services without a component on the missing side, and those on the other one.

    Counts tell the sides. Components are listed for these names only, and not at all where nobody reads the lists. The
    first NAMED are named and the others counted; peer_chunks() lists all of them.
    """
    mine = _of_kind(endpoints, kind)
    sides = mine.groupBy(F.col("name").alias("_name")).agg(F.count_if(F.col("rel") == missing).alias("n"), F.count("*").alias("_all"))
    one_sided = mine.join(sides.filter("n = 0"), F.col("name").eqNullSafe(F.col("_name"))).select("name", "rel", "component", "seq", "_all")
    # of a crowded name the first ones are ranked, which each task does for its own rows before they are sent
    rank = F.row_number().over(Window.partitionBy("name").orderBy("seq"))
    first = one_sided.filter(F.col("_all") > NAMED).withColumn("_nth", rank).filter(F.col("_nth") <= NAMED).drop("_nth")
    some = one_sided.filter(F.col("_all") <= NAMED).unionByName(first).groupBy("name", "_all").agg(_side(there))
    more = F.when(F.col("_all") > NAMED, F.concat(F.lit(" and "), F.col("_all") - NAMED, F.lit(" more"))).otherwise("")
    return some.select("name", F.concat(there, more).alias(there))


def kind_summary(endpoints: DataFrame, packages: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(kind, n) over six kinds, zero-filled."""
    spark = endpoints.sparkSession
    counted = (
        comm_vertices(endpoints).select("kind")
        .unionAll(components(endpoints).select(F.lit("Node").alias("kind")))
        .unionAll(packages.select(F.lit("Package").alias("kind")))
        .unionAll(interfaces.select(F.lit("Interface").alias("kind")))
        .groupBy("kind").agg(F.count("*").alias("n"))
    )
    kinds = spark.createDataFrame([(k,) for k in ("Package", "Node", "Topic", "Service", "Action", "Interface")], "kind string")
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of the seeds and their direct neighbours."""
    ids = seeds.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return ids.unionAll(out).unionAll(back).distinct()


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def connections(endpoints: DataFrame) -> DataFrame:
    """(package, component, name, rel, others): the other components at each topic of a component."""
    use = endpoints.withColumns({"rel": _by_role(0), "kind": _by_role(1)}).filter("kind = 'Topic'").select("package", "component", "name", "rel").distinct()
    there = use.select("package", "component", "name").distinct().groupBy("name").agg((F.count("*") - 1).alias("others")).filter("others > 0")
    return use.join(there, "name").select("package", "component", "name", "rel", "others")


def parents(endpoints: DataFrame) -> DataFrame:
    """(id, parent): the first component that publishes or provides, else the package of the first other."""
    rows = endpoints.select(F.concat(_by_role(2), "name").alias("id"), _by_role(0).alias("rel"), node_id().alias("node"), "package", "seq")
    source = F.col("rel").isin("publishes", "provides")
    return rows.groupBy("id").agg(
        F.coalesce(F.min_by("node", F.when(source, F.col("seq"))), F.concat(F.lit("pkg:"), F.min_by("package", "seq"))).alias("parent")
    )


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a path of one step or more, semi-naively: only new pairs are extended, and each is written once."""
    steps = save(edges.select("src", "dst").distinct(), "graph")
    reached = frontier = steps
    while True:
        longer = frontier.select("src", F.col("dst").alias("mid")).join(steps.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = save(longer.join(reached, ["src", "dst"], "left_anti"), "graph")
        if frontier.isEmpty():
            drop(frontier)
            return reached
        reached = reached.unionAll(frontier)


def cyclic(edges: DataFrame) -> DataFrame:
    """(id) of the vertices on a cycle."""
    return strong_components(edges).select("id")


MERMAID_SHAPES = {"Package": ('["', '"]'), "Topic": ('(["', '"])'), "Service": ('{{"', '"}}'), "Action": ('>"', '"]'), "Node": ('("', '")'), "Interface": ('[/"', '"/]')}


def mermaid_vertices(vertices: DataFrame, slug) -> DataFrame:
    """(id, line): a diagram line for each vertex (id, kind, name)."""
    left, right = F.lit('["'), F.lit('"]')
    for kind, (a, b) in MERMAID_SHAPES.items():
        left, right = F.when(F.col("kind") == kind, a).otherwise(left), F.when(F.col("kind") == kind, b).otherwise(right)
    return vertices.select("id", F.concat(slug(F.col("id")), left, F.replace("name", F.lit('"'), F.lit("'")), right).alias("line"))


SUBGRAPHS = {
    "deps": (("Package",), ("depends_on",)),
    "comms": (("Node", "Topic", "Service", "Action"), COMM_RELATIONS),
}


def subgraph(vertices: DataFrame, edges: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a view: deps, comms or full."""
    if view == "full":
        return vertices, edges
    if view not in SUBGRAPHS:
        raise ValueError(f"unknown view {view}")
    kinds, relations = SUBGRAPHS[view]
    kept = vertices.filter(F.col("kind").isin(*kinds))
    return kept, induced(edges.filter(F.col("rel").isin(*relations)), kept)


def focus(vertices: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The vertices called name, or else those of the package of that name, with their neighbours and the edges among them."""
    called = vertices.filter(F.col("name") == name)
    seeds = vertices.filter(F.col("name") == name)
    if seeds.isEmpty():
        seeds = vertices.filter(F.col("package") == name)
    near = neighbourhood(edges, seeds)
    return vertices.join(near, "id", "left_semi"), induced(edges, near)


def label_search(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(id, hit): vertices whose name contains the text in any case, and their neighbours."""
    hits = vertices.filter(F.contains(F.lower("name"), F.lit(text.lower()))).select("id")
    return neighbourhood(edges, hits).join(hits.distinct().withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


def cross_package_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, key): edges between vertices of different packages. owners: (id, package)."""
    one = owners.select(F.col("id").alias("src"), F.col("package").alias("_from"))
    two = owners.select(F.col("id").alias("dst"), F.col("package").alias("_to"))
    return edges.join(one, "src").join(two, "dst").filter("_from <> _to").select("src", "dst", "key")


def edge_bundles(edges: DataFrame) -> DataFrame:
    """(a, b, n): how many edges run between two vertices, in either direction."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


#: Endpoints of a block in connection_rows(), about: so many of the chosen ones meet so many others in one place.
BLOCK = 1000


def connection_rows(endpoints: DataFrame, chosen: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each endpoint of the chosen components (package, component): who else is there, a row for each, or one with null peers.

    (package, component, kind, name, role, msg_type, seq, peer_rel, peer_package, peer_component, peer_seq). At topics these
    are the other publishers and subscribers; at services and actions the other callers only. Either side of a name is dealt in blocks
    of about `block` endpoints by their hash, and each block of the chosen ones meets each block of the others in a place of its own. So a
    crowded name is shared by many tasks, and what an endpoint meets at once is a list of about a block. The rows are still as many as the pairs.
    """
    picked = chosen.select("package", "component").distinct().withColumn("_mine", F.lit(True))
    rows = endpoints.select("package", "component", _by_role(1).alias("kind"), "name", _by_role(0).alias("role"), "msg_type", "seq")
    # read three times
    rows = save(rows.join(picked, ["package", "component"], "left"), "connected")
    heard = (F.col("kind") == "Topic") | (F.col("role") == "calls")
    ends = {f"_{f.__name__}_{c}": f(F.when(heard, F.col(c))) for f in (F.min, F.max) for c in ("package", "component")}
    sizes = rows.groupBy("kind", "name").agg(
        F.ceil(F.count("_mine") / block).alias("_mines"), F.ceil(F.count(F.when(heard, True)) / block).alias("_theirs"), *(c.alias(k) for k, c in ends.items())
    ).filter("_mines > 0")
    at = F.xxhash64("package", "component", "role", "seq")

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    # someone of a name is of another component if the least or the greatest is; who is alone goes to no block of others
    others = F.expr(" OR ".join(f"{k} <> {k.rpartition('_')[2]}" for k in ends))
    mine = rows.filter("_mine").join(sizes, ["kind", "name"], "left").withColumn("_alone", ~F.coalesce(others, F.lit(False))).select(
        "package", "component", "kind", "name", "role", "msg_type", "seq", "_alone", F.pmod(at, "_mines").alias("_i"),
        F.explode(F.when(F.col("_alone"), F.array(F.lit(-1).cast("bigint"))).otherwise(upto("_theirs"))).alias("_j"),
    )
    peer = F.struct(F.col("role").alias("peer_rel"), F.col("package").alias("peer_package"), F.col("component").alias("peer_component"), F.col("seq").alias("peer_seq"))
    there = rows.filter(heard).join(sizes, ["kind", "name"]).select("kind", "name", F.explode(upto("_mines")).alias("_i"), F.pmod(at, "_theirs").alias("_j"), peer.alias("_peer"))
    # what meets is far more than what is read, so the join is dealt by number and not by the bytes that come in
    context = endpoints.sparkSession.sparkContext
    parts = max(4 * context.defaultParallelism, int(endpoints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = ["kind", "name", "_i", "_j"]
    lists = there.repartition(parts, *place).groupBy(*place).agg(F.collect_list("_peer").alias("_peers"))
    met = mine.repartition(parts, *place).join(lists, place, "left").withColumn("_peer", F.explode_outer("_peers"))
    return met.filter("_alone OR package <> _peer.peer_package OR component <> _peer.peer_component").select(
        "package", "component", "kind", "name", "role", "msg_type", "seq", "_peer.*"
    )


#: Relations that the nesting of a compound view already shows.
NESTED_RELATIONS = ("defined_in", "uses_interface")


def compound(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A view as nested elements: (id, kind, name, label, parent), and the edges that the nesting does not show.

    vertices: (id, kind, name, package); edges: (src, dst, rel, key, seq). Components and interfaces lie in their package, topics,
    services and actions in the first component that publishes or provides them, else in the package of the
    first other one. Packages that are parents and no vertices of the view are added.
    """
    nodes = vertices.filter("kind = 'Node'").select(F.col("id").alias("src"), F.col("package").alias("_pkg"))
    ends = edges.filter(F.col("rel").isin(*COMM_RELATIONS)).join(nodes, "src")
    source = F.col("rel").isin("publishes", "provides")
    homes = ends.groupBy(F.col("dst").alias("id")).agg(
        F.coalesce(F.min_by("src", F.when(source, F.col("seq"))), F.concat(F.lit("pkg:"), F.min_by("_pkg", "seq"))).alias("_home")
    )
    inside = F.when(F.col("kind").isin("Node", "Interface") & (F.col("package") != ""), F.concat(F.lit("pkg:"), "package"))
    parent = F.when(F.col("kind").isin("Topic", "Service", "Action"), F.col("_home")).otherwise(inside)
    placed = vertices.join(homes, "id", "left").select("id", "kind", "name", short_label(F.col("kind"), F.col("name")).alias("label"), parent.alias("parent"))
    missing = placed.filter(F.col("parent").startswith("pkg:")).select(F.col("parent").alias("id")).distinct().join(placed.select("id"), "id", "left_anti")
    name = F.substring("id", 5, 1 << 30)
    packages = missing.select("id", F.lit("Package").alias("kind"), name.alias("name"), name.alias("label"), F.lit(None).cast("string").alias("parent"))
    return placed.unionByName(packages), edges.filter(~F.col("rel").isin(*NESTED_RELATIONS))


def visible_counts(vertices: DataFrame, edges: DataFrame, hidden_kinds: list[str] = (), hidden_relations: list[str] = ()) -> DataFrame:
    """(part, what, n): what a view shows once kinds and relations are hidden; an edge is shown if both its ends are."""
    shown = vertices.filter(~F.col("kind").isin(*hidden_kinds)) if hidden_kinds else vertices
    left = edges.filter(~F.col("rel").isin(*hidden_relations)) if hidden_relations else edges
    count = lambda table, part, what: table.groupBy(F.lit(part).alias("part"), F.col(what).alias("what")).agg(F.count("*").alias("n"))
    return count(shown, "vertices", "kind").unionAll(count(induced(left, shown), "edges", "rel"))


def selection(elements: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of the seeds, their neighbours, and the containers of all of these. elements: (id, parent) of a compound view."""
    near = neighbourhood(edges, seeds)
    up = elements.select("id", "parent").filter("parent IS NOT NULL")
    first = near.join(up, "id").select(F.col("parent").alias("id"))
    second = first.join(up, "id").select(F.col("parent").alias("id"))
    return near.unionAll(first).unionAll(second).distinct()


MERMAID_ARROWS = {"publishes": "-->|pub|", "subscribes": "-->|sub|", "depends_on": "-.->", "provides": "-->|srv|", "calls": "-.->|call|"}


def mermaid_edges(edges: DataFrame, slug) -> DataFrame:
    """(src, dst, key, line): a diagram line for each edge."""
    arrow = F.lit("-->")
    for rel, text in MERMAID_ARROWS.items():
        arrow = F.when(F.col("rel") == rel, text).otherwise(arrow)
    arrow = F.when((F.col("rel") == "provides") & F.col("dst").startswith("action:"), "-->|act|").otherwise(arrow)
    return edges.select("src", "dst", "key", F.concat(slug(F.col("src")), F.lit(" "), arrow, F.lit(" "), slug(F.col("dst"))).alias("line"))


DOT_SHAPES = {"Package": "shape=box", "Topic": "shape=ellipse, color=blue", "Service": "shape=diamond, color=green", "Action": "shape=hexagon, color=red", "Node": "shape=rectangle, color=orange", "Interface": "shape=parallelogram"}


def dot_vertices(vertices: DataFrame, slug) -> DataFrame:
    """(id, line) in DOT."""
    look = F.lit("")
    for kind, text in DOT_SHAPES.items():
        look = F.when(F.col("kind") == kind, f", {text}").otherwise(look)
    return vertices.select("id", F.concat(slug(F.col("id")), F.lit(' [label="'), F.replace("name", F.lit('"'), F.lit("'")), F.lit('"'), look, F.lit("];")).alias("line"))


def dot_edges(edges: DataFrame, slug) -> DataFrame:
    """(src, dst, key, line) in DOT."""
    look = F.when(F.col("rel") == "depends_on", F.lit("style=dashed")).otherwise(F.concat(F.lit('label="'), "rel", F.lit('"')))
    return edges.select("src", "dst", "key", F.concat(slug(F.col("src")), F.lit(" -> "), slug(F.col("dst")), F.lit(" ["), look, F.lit("];")).alias("line"))
