"""Reports of a source-text project: JSON, Markdown, HTML and DOT. Each collects lists of bounded length only."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import functions as F

from resgraph.operators.analyzers import Analyzers
from resgraph.session import cut

#: Fill colours by node type.
COLOURS = {"object": "lightblue", "room": "lightgreen", "script": "lightyellow", "sprite": "lightpink", "sound": "lavender", "font": "lightgrey"}


def summary(a: Analyzers) -> dict[str, int]:
    counts = {name: getattr(a.p, name).count() for name in ("objects", "rooms", "scripts", "sprites", "sounds", "fonts", "dialogues")}
    return counts | {f"dead_{r['kind']}": r["count"] for r in a.dead().groupBy("kind").count().collect()}


def top(a: Analyzers, n: int = 100) -> list[dict]:
    return [r.asDict() for r in a.top(n).collect()]


def to_json(a: Analyzers, path: str, n: int = 100) -> None:
    graph = {"nodes": a.nodes().count(), "edges": a.edges().count()}
    Path(path).write_text(json.dumps({"summary": summary(a), "suspicious": top(a, n), "graph": graph}, indent=2))


def to_markdown(a: Analyzers, path: str, n: int = 100) -> None:
    out = ["# Analysis", "", "## Summary", ""]
    out += [f"- {k}: {v}" for k, v in summary(a).items()] + ["", "## Suspicious", ""]
    for r in top(a, n):
        reasons = r["reasons"].split("; ")
        more = f" (+{len(reasons) - 2} more)" if len(reasons) > 2 else ""
        out.append(f"- **{r['name']}** [{r['resource_type']}] {r['score']} {r['level']}: {'; '.join(reasons[:2])}{more}")
    for kind in ("object", "room", "script", "sprite", "sound", "dialogue"):
        dead = a.dead().where(F.col("kind") == kind)
        names, total = [r["name"] for r in dead.orderBy("name").limit(100).collect()], dead.count()
        out += ["", f"## Dead {kind}s ({total})", "", *[f"- {x}" for x in names]] + ([f"- ... and {total - 100} more"] if total > 100 else [])
    Path(path).write_text("\n".join(out) + "\n")


def to_html(a: Analyzers, path: str, n: int = 100) -> None:
    rows = "".join(f"<tr><td>{html.escape(r['name'])}</td><td>{r['resource_type']}</td><td>{r['score']}</td><td>{html.escape(r['reasons'])}</td></tr>" for r in top(a, n))
    facts = "".join(f"<li>{html.escape(k)}: {v}</li>" for k, v in summary(a).items())
    Path(path).write_text(f"<!DOCTYPE html><meta charset=utf-8><title>Analysis</title><ul>{facts}</ul><table><tr><th>name<th>type<th>score<th>reasons</tr>{rows}</table>")


def to_dot(a: Analyzers, path: str, max_nodes: int = 500) -> None:
    """The nodes of most edges, and the edges between them."""
    e = a.edges()
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).groupBy("node_id").count()
    most = cut(a.nodes().join(ends, "node_id", "left").orderBy(F.desc_nulls_last("count"), "node_id").limit(max_nodes))
    kept = most.select("node_id")
    between = e.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    lines = ["digraph G {"]
    lines += [f'  "{r["node_id"]}" [label="{r["node_id"].replace("_", chr(92) + "n")}", style=filled, fillcolor={COLOURS.get(r["type"], "white")}];' for r in most.orderBy("node_id").collect()]
    lines += [f'  "{r["src"]}" -> "{r["dst"]}" [label="{r["label"]}"];' for r in between.orderBy("src", "dst").collect()]
    Path(path).write_text("\n".join([*lines, "}"]) + "\n")
