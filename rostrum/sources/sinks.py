"""Sinks: tables, manifests, graphs and dashboard bundles."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header, a file for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_annotations(df: DataFrame, path: str, modules: str, normalisation: str) -> None:
    """Adds rows to an annotation store, in the partition of their chain and normalisation."""
    rows = df.withColumns({"modules": F.lit(modules), "normalisation": F.lit(normalisation)})
    rows.write.mode("append").partitionBy("modules", "normalisation").parquet(path)


def manifest(facts: dict[str, DataFrame], **extra) -> str:
    """Pretty JSON of tables of one row each, and whatever else is given."""
    rows = {name: df.first().asDict(recursive=True) for name, df in facts.items()}
    return json.dumps(rows | extra, indent=2, ensure_ascii=False, default=str, sort_keys=True)


def node_link(nodes: DataFrame, edges: DataFrame, **extra) -> DataFrame:
    """One row (value): the graph as node-link JSON. For graphs that a browser can show."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in nodes.columns if c != "id"]))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")]))).alias("links"))
    more = [F.lit(v).alias(k) for k, v in extra.items()]
    body = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links", *more)
    return n.join(e, F.lit(True)).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def graphml(nodes: DataFrame, edges: DataFrame, unknown: str = "unknown") -> str:
    """The graph as GraphML; null attributes are ``unknown``, truth values are words, numbers stay numbers. For graphs that a desktop tool can show."""

    def kind(df: DataFrame, c: str) -> str:
        return {"int": "int", "bigint": "long", "double": "double", "float": "double"}.get(dict(df.dtypes)[c], "string")

    def text(v) -> str:
        return unknown if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    out, keys = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'], {}
    for df, of, skip in ((nodes, "node", ("id",)), (edges, "edge", ("src", "dst"))):
        for c in (x for x in df.columns if x not in skip):
            keys[of, c] = f"d{len(keys)}"
            out.append(f'<key id="{keys[of, c]}" for="{of}" attr.name={quoteattr(c)} attr.type="{kind(df, c)}"/>')
    out.append('<graph edgedefault="directed">')
    data = lambda of, r, skip: "".join(f'<data key="{keys[of, c]}">{escape(text(v))}</data>' for c, v in r.items() if c not in skip)
    out += [f"<node id={quoteattr(str(r['id']))}>{data('node', r, ('id',))}</node>" for r in (x.asDict() for x in nodes.orderBy("id").toLocalIterator())]
    out += [
        f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data('edge', r, ('src', 'dst'))}</edge>"
        for r in (x.asDict() for x in edges.orderBy("src", "dst").toLocalIterator())
    ]
    return "\n".join([*out, "</graph>", "</graphml>"])


def dashboard(parts: dict[str, DataFrame]) -> DataFrame:
    """One row (value): aggregated tables as one JSON object of arrays of objects."""
    rows = [df.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias(name)) for name, df in parts.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.join(r, F.lit(True))
    pieces = [F.concat(F.lit(f'"{name}":'), F.col(name)) for name in parts]
    return whole.select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("value"))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as Markdown."""
    rows = df.limit(most).collect()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
