"""Diagrams and reports. Lines are made by tasks; what a person is to read is put together at the end."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import slug
from ..operators import assembly, graph, levels
from ..operators.health import workspace_score
from ..operators.rules import findings_by_rule, violation_summary
from .model import Model
from .policy import ordered
from .sinks import write_document


def _view(model: Model, view: str, name: str | None) -> tuple[DataFrame, DataFrame]:
    vertices, edges = graph.subgraph(model.vertices, model.edges, view)
    return graph.focus(vertices, edges, name) if name else (vertices, edges)


def _lines(table: DataFrame, *order: str) -> Iterator[str]:
    for row in table.orderBy(*order).toLocalIterator():
        yield row["line"]


_FRAMES = {"mermaid": (["graph LR"], []), "dot": (["digraph architecture {", "  rankdir=LR;"], ["}"])}


def _bodies(model: Model, form: str, view: str, name: str | None) -> list[tuple[DataFrame, tuple[str, ...]]]:
    vertices, edges = _view(model, view, name)
    draw = {"mermaid": (graph.mermaid_vertices, graph.mermaid_edges), "dot": (graph.dot_vertices, graph.dot_edges)}[form]
    return [(draw[0](vertices, slug), ("id",)), (draw[1](edges, slug), ("src", "dst", "key"))]


def _diagram(model: Model, form: str, view: str, name: str | None) -> Iterator[str]:
    header, footer = _FRAMES[form]
    yield from header
    for lines, order in _bodies(model, form, view, name):
        yield from _lines(lines, *order)
    yield from footer


def mermaid(model: Model, view: str = "deps", name: str | None = None) -> Iterator[str]:
    return _diagram(model, "mermaid", view, name)


def dot(model: Model, view: str = "deps", name: str | None = None) -> Iterator[str]:
    return _diagram(model, "dot", view, name)


def write(model: Model, path: str, form: str = "mermaid", view: str = "deps", name: str | None = None) -> None:
    """A diagram of any size, written by tasks below path; its part files in the order of their names are the document."""
    header, footer = _FRAMES[form]
    write_document(_bodies(model, form, view, name), path, header, footer)


def json_rows(model: Model, view: str = "full", name: str | None = None) -> DataFrame:
    """(part, line): a JSON object for each vertex and edge; write it with df.write.text() at any size."""
    vertices, edges = _view(model, view, name)
    return vertices.select(F.lit("vertex").alias("part"), F.to_json(F.struct("*")).alias("line")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst", "rel", "key")).alias("line"))
    )


def graph_json(model: Model, view: str = "full", name: str | None = None) -> Iterator[str]:
    """A JSON object a line: of the full view all that the model says, {"part": table, "row": ...}; of others their vertices and edges."""
    if view != "full" or name:
        yield from _lines(json_rows(model, view, name), "part", "line")
        return
    for part, table in model.tables().items():
        rows = table.select(F.to_json(F.struct(F.lit(part).alias("part"), F.struct("*").alias("row"))).alias("line"))
        yield from _lines(rows, "line")


VIEWS = ("deps", "comms", "full")


def _nested(model: Model, view: str) -> tuple[DataFrame, DataFrame]:
    """The elements of a view, and those of its edges that nesting does not show."""
    vertices, edges = graph.subgraph(model.vertices, model.edges, view)
    return graph.compound(vertices, model.comm_edges)[0], edges.filter(~F.col("rel").isin(*graph.NESTED_RELATIONS))


def write_levels(model: Model, path: str, size: int = levels.PAGE) -> None:
    """What each container of each view shows, as JSON lines in a folder for each view below path, by container and page; tasks write them, at any size."""
    parts = max(1, int(model.packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for view in VIEWS:
        elements, edges = _nested(model, view)
        rows = levels.pages(levels.level_elements(elements), levels.level_edges(elements, edges), size)
        order = ("container", "part", "nth")
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path.rstrip('/')}/{view}")


def _piece(model: Model, view: str, container: str | None, number: int, size: int) -> tuple[bool, DataFrame]:
    """Is the view small enough to be shown whole; and the rows (part, nth, line) that a page shows of it."""
    elements, edges = _nested(model, view)
    inside = levels.level_elements(elements)
    if container is None and number == 0 and elements.limit(size + 1).count() <= size and edges.limit(size + 1).count() <= size:
        said = inside.select(F.lit("elements").alias("part"), F.col("id").alias("nth"), F.to_json(F.struct("id", "kind", "label", "container", "inside")).alias("line"))
        return True, said.unionByName(
            edges.select(F.lit("edges").alias("part"), F.concat_ws(" ", "src", "dst", "key").alias("nth"), F.to_json(F.struct("src", "dst", "rel", "key")).alias("line"))
        )
    at = F.col("container").eqNullSafe(F.lit(container))
    shown = levels.pages(inside.filter(at), levels.level_edges(elements, edges).filter(at), size)
    return False, shown.filter(F.col("page") == number).select("part", "nth", "line")


_SCRIPT = """
const g=JSON.parse(document.getElementById('graph').textContent),out=document.getElementById('out');
const put=(to,tag,text)=>{const x=document.createElement(tag);x.textContent=text;to.append(x);return x};
put(out,'p',Object.entries(g.summary).map(([k,n])=>k+' '+n).join(', '));
for(const [name,v] of Object.entries(g.views)){
  put(out,'h2',name);const by=new Map();
  for(const e of v.elements){const k=e.container??null;by.has(k)||by.set(k,[]);by.get(k).push(e)}
  const list=(to,k)=>{for(const e of by.get(k)??[]){const text=e.kind+' '+e.label+(e.inside?' ('+e.inside+')':'');
    if(!by.has(e.id)){const x=put(to,'div',text);x.title=e.id;continue}
    const d=put(to,'details',''),s=put(d,'summary',text);s.title=e.id;d.addEventListener('toggle',()=>list(d,e.id),{once:true})}};
  list(out,v.whole?null:g.container??null);
  put(out,'pre',v.edges.map(x=>x.src+' '+x.rel+' '+x.dst+(x.n>1?' ('+x.n+')':'')).join('\\n'));
}"""


def page(model: Model, title: str, container: str | None = None, number: int = 0, size: int = levels.PAGE) -> Iterator[str]:
    """A self-contained page of bounded size: a summary, and the elements and edges of each view.

    A view of up to `size` elements and edges is there whole, and its containers open on the page. Of a larger one the page has what its top or the
    given container shows, with the numbers of what lies inside and of the edges between its parts: pages 0, 1, ... of `size` elements and `size` edges,
    which together are all of it. write_levels() has the pages of all containers.
    """
    safe = lambda value: json.dumps(value, ensure_ascii=False).replace("</", "<\\/")
    said = html.escape(title)
    yield f"<!doctype html><meta charset='utf-8'><title>{said}</title><h1>{said}</h1><script type='application/json' id='graph'>"
    counts = {r["kind"]: r["n"] for r in assembly.summary(model.vertices).collect()}
    yield f'{{"summary":{safe(counts)},"container":{safe(container)},"page":{number},"views":{{'
    for k, view in enumerate(VIEWS):
        whole, rows = _piece(model, view, container, number, size)
        yield f'{"," if k else ""}{safe(view)}:{{"whole":{safe(whole)}'
        for part in ("elements", "edges"):
            yield f',"{part}":['
            before = ""
            for line in _lines(rows.filter(F.col("part") == part), "nth"):
                yield before + line.replace("</", "<\\/")
                before = ","
            yield "]"
        yield "}"
    yield "}}"
    yield f"</script><div id='out'></div><script>{_SCRIPT}</script>"


def export(model: Model, path: str) -> None:
    """Every table of the model as JSON lines, in a folder of its name below path; tasks write them, at any size."""
    for name, table in model.tables().items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def report(violations: DataFrame, model: Model | None = None) -> dict:
    """Counts and findings of an audit or a policy, and of a model its packages and health."""
    out = {
        "violations": violation_summary(violations).first().asDict(),
        "by_rule": {r["rule_type"]: r["n"] for r in findings_by_rule(violations).collect()},
        "findings": [r.asDict() for r in ordered(violations).toLocalIterator()],
    }
    if model is not None:
        out |= {"total_packages": model.packages.count(), "workspace_health": workspace_score(model.scores).first()["score"]}
    return out


def report_json(violations: DataFrame, model: Model | None = None) -> str:
    return json.dumps(report(violations, model), ensure_ascii=False, indent=2)
