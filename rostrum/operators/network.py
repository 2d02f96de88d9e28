"""Names resolved to people, and directed weighted graphs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, is_remark, name_key, spans
from ..profile import HUNGARIAN, Profile
from ..storage import stored
from .events import classified, own_side, split_lines


def registry(people: DataFrame, profile: Profile = HUNGARIAN, name: str = "name", order: str = "seq", by: tuple[str, ...] = (), keep: tuple[str, ...] = ("person_id", "faction")) -> DataFrame:
    """(by..., name_key, name, keep...): of people with the same key the first, for each value of ``by`` (a cycle, say)."""
    rows = people.withColumn("name_key", name_key(F.col(name), profile)).where(F.col("name_key") != "")
    first = F.min_by(F.struct(F.col(name).alias("name"), *keep), order).alias("p")
    return rows.groupBy(*by, "name_key").agg(first).select(*by, "name_key", "p.*")


def _scoped(rows: DataFrame, by: tuple[str, ...], key: str) -> DataFrame:
    """Adds ``key``: the name key within the values of ``by``."""
    return rows.withColumn(key, F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"b{i}") for i, c in enumerate(by)), F.col("name_key").alias("k")))


def resolved(mentions: DataFrame, people: DataFrame, profile: Profile = HUNGARIAN, mention: str = "mention", by: tuple[str, ...] = (), bring: tuple[str, ...] = ()) -> DataFrame:
    """Adds name_key, person_id, how (exact, tokens, or null) and ``bring``, columns of people, to mentions of names.

    A key that no person has is tried by its words: two or more that all
    occur in one person's name and in no other's. A key meets only those whose
    names have the rarest of its words, where all must be found; a given name
    that many bear pairs nobody, and a word that none bears ends the search.
    With ``by`` names mean people of the same values, of their cycle, say.
    """
    keyed = _scoped(mentions.withColumn("name_key", name_key(F.col(mention), profile)), by, "__key")
    scope = lambda c: F.struct(*(F.col(f"{c}.b{i}").alias(f"b{i}") for i in range(len(by))), F.lit("").alias("end"))
    known = _scoped(people, by, "__of").select("__of", F.struct("person_id", *bring).alias("__person"))
    exact = known.select(F.col("__of").alias("__k"), F.col("__person").alias("__exact"))
    keyed = keyed.join(exact, F.col("__key") == F.col("__k"), "left")
    open_ = keyed.where(F.col("__k").isNull()).select("__key").distinct()
    asked = open_.withColumn("words", F.array_distinct(F.split("__key.k", " "))).where(F.size("words") >= 2)
    names = known.select("__person", scope("__of").alias("in"), F.array_distinct(F.split("__of.k", " ")).alias("has"))
    named = names.select("__person", "has", "in", F.explode("has").alias("w"))
    bearers = named.groupBy(F.col("in").alias("among"), F.col("w").alias("b")).agg(F.count(F.lit(1)).alias("bearers"))
    each = asked.select("__key", scope("__key").alias("here"), "words", F.explode("words").alias("word")).join(bearers, (F.col("here") == F.col("among")) & (F.col("word") == F.col("b")))
    rare = each.groupBy("__key", "here").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("borne"), F.min_by("word", F.struct("bearers", "word")).alias("word"))
    met = rare.where(F.col("borne") == F.size("words")).join(named, (F.col("here") == F.col("in")) & (F.col("word") == F.col("w"))).where(F.size(F.array_except("words", "has")) == 0)
    one = met.groupBy(F.col("__key").alias("__t")).agg(F.count(F.lit(1)).alias("c"), F.first("__person").alias("__tokens"))
    out = keyed.join(one.where("c = 1").drop("c"), F.col("__key") == F.col("__t"), "left")
    how = F.when(F.col("__k").isNotNull(), "exact").when(F.col("__t").isNotNull(), "tokens")
    person = F.coalesce("__exact", "__tokens")
    return out.withColumns({"how": how, **{c: person[c] for c in ("person_id", *bring)}}).drop("__k", "__exact", "__t", "__tokens", "__key")


def node_id(person_id, key):
    return F.coalesce(person_id.cast("string"), F.concat(F.lit("name:"), key))


def collapsed(edges: DataFrame, drop_self_loops: bool = True) -> DataFrame:
    """(src, dst, weight): parallel edges counted."""
    rows = edges.where(F.col("src") != F.col("dst")) if drop_self_loops else edges
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def degrees(graph: DataFrame) -> DataFrame:
    """(id, given, targets, received, sources): weighted and plain degrees of all nodes of (src, dst, weight), in one pass."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out")))).alias("e")
    rows = graph.select("weight", ends).select("weight", "e.id", "e.out")
    out, into = F.col("out"), ~F.col("out")
    return rows.groupBy("id").agg(
        F.sum(F.when(out, F.col("weight")).otherwise(0)).alias("given"), F.count_if(out).alias("targets"),
        F.sum(F.when(into, F.col("weight")).otherwise(0)).alias("received"), F.count_if(into).alias("sources"),
    )


def rolled_up(graph: DataFrame, nodes: DataFrame, attribute: str, missing: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(edges between values of an attribute, members of each); null is ``missing``, loops stay."""
    value = F.coalesce(F.col(attribute).cast("string"), F.lit(missing))
    a = nodes.select(F.col("id").alias("__a"), value.alias("src_group"))
    b = nodes.select(F.col("id").alias("__b"), value.alias("dst_group"))
    edges = graph.join(a, F.col("src") == F.col("__a"), "left").join(b, F.col("dst") == F.col("__b"), "left")
    groups = [F.coalesce(c, F.lit(missing)).alias(c) for c in ("src_group", "dst_group")]
    edges = edges.groupBy(*groups).agg(F.sum("weight").alias("weight"))
    return edges, nodes.groupBy(value.alias("grp")).agg(F.count(F.lit(1)).alias("members"))


def crossing(graph: DataFrame, nodes: DataFrame, side: str = "side") -> DataFrame:
    """Adds ``crossing`` to edges: within, across, or unknown if an end's side is."""
    a = nodes.select(F.col("id").alias("__a"), F.col(side).alias("__sa"))
    b = nodes.select(F.col("id").alias("__b"), F.col(side).alias("__sb"))
    rows = graph.join(a, F.col("src") == F.col("__a"), "left").join(b, F.col("dst") == F.col("__b"), "left")
    label = F.when(F.col("__sa").isNull() | F.col("__sb").isNull(), "unknown").when(F.col("__sa") == F.col("__sb"), "within").otherwise("across")
    return rows.withColumn("crossing", label).drop("__a", "__b", "__sa", "__sb")


def interjections(events: DataFrame, speaker: str = "speaker") -> DataFrame:
    """(src, dst, edge_type): from who interjects to whom it is addressed, or else to who has the floor."""
    target = F.coalesce(F.col("addressee"), F.col(speaker))
    kind = F.when(F.col("addressee").isNotNull(), "address").otherwise("interruption")
    return events.where(F.col("interjector").isNotNull()).select(F.col("interjector").alias("src"), target.alias("dst"), kind.alias("edge_type"))


def _named(events: DataFrame, people: DataFrame, mentions: dict[str, str], profile: Profile) -> DataFrame:
    """Joins who is meant to columns that mention names: for each a struct (label, id, person_id, faction, side, is_mp, resolved, match).

    Each distinct name of a cycle is looked up once. Who isn't known keeps the
    name as written, and an id made of it.
    """
    said = events.select("cycle", F.explode(F.array_distinct(F.array(*(F.coalesce(c, F.lit("")) for c in mentions.values())))).alias("mention")).distinct()
    known = resolved(said, people, profile, by=("cycle",), bring=("name", "faction", "side", "is_mp"))
    found = F.col("how").isNotNull()
    who = F.struct(
        F.coalesce("name", "mention").alias("label"), node_id(F.col("person_id"), F.col("name_key")).alias("id"), F.col("person_id").cast("string").alias("person_id"),
        "faction", "side", "is_mp", found.alias("resolved"), F.coalesce("how", F.lit("none")).alias("match"),
    )
    known = stored(known.select(F.col("cycle").alias("__cycle"), "mention", who.alias("who")))
    for name, column in mentions.items():
        one = known.select("__cycle", F.col("mention").alias("__mention"), F.col("who").alias(name))
        events = events.join(one, (F.col("cycle") == F.col("__cycle")) & (F.coalesce(column, F.lit("")) == F.col("__mention"))).drop("__cycle", "__mention")
    return events


_WHO = ("id", "person_id", "faction", "side", "is_mp", "resolved", "match")


def _edge(kind, source: str, target) -> list:
    """The columns of an edge between two structs of ``_named``."""
    ends = [c for end, who in (("source", F.col(source)), ("target", target)) for c in (who["label"].alias(end), *(who[k].alias(f"{end}_{k}") for k in _WHO))]
    return [kind.alias("edge_type"), *ends, (F.col(source)["id"] == target["id"]).alias("self_loop")]


def chamber_people(speeches: DataFrame, profile: Profile = HUNGARIAN, order: str = "speech_uid") -> DataFrame:
    """(cycle, name_key, name, person_id, faction, side, is_mp): who held the floor in a cycle, as first seen there.

    ``speeches`` has cycle and speaker (person_id, label, faction, office, is_mp). The
    side is the faction's, or government by an office alone.
    """
    rows = speeches.select("cycle", order, "speaker.*").where(F.col("label") != "")
    side, _ = own_side(F.col("faction"), F.col("office"), F.col("cycle"), profile)
    rows = rows.withColumns({"side": side, "faction": F.nullif("faction", F.lit(""))})
    return registry(rows, profile, "label", order, ("cycle",), ("person_id", "faction", "side", "is_mp"))


def heckles(speeches: DataFrame, profile: Profile = HUNGARIAN, people: DataFrame | None = None, text: str = "text", order: str = "speech_uid") -> DataFrame:
    """An edge for each named interjection in the brackets of speeches, both ends resolved among the people of the cycle.

    ``speeches`` has cycle, ``order`` (its id), speaker and text; its other
    columns but text are kept. An interjection goes to who has the floor
    (``interruption``), or to the third party that it names (``address``).
    Columns: edge_type, source and target (labels, and for each id, person_id,
    faction, side, is_mp, resolved, match), floor_holder, floor_holder_id,
    self_loop, quote, span_no and event_no (its place in the speech). Names
    that nobody or several bear stay as they are.
    """
    people = chamber_people(speeches, profile, order) if people is None else people
    rest = [c for c in speeches.columns if c not in (text, "speaker")]
    rows = speeches.select(*rest, F.col("speaker.label").alias("__floor"), F.posexplode(spans(F.col(text))).alias("span_no", "span"))
    rows = classified(split_lines(rows.where(has_text(F.col("span")) & is_remark(F.col("span"))), "span", profile), profile)
    rows = _named(stored(rows.where("kind = 'interjection'").drop("span")), stored(people), {"__source": "interjector", "__other": "addressee", "__holder": "__floor"}, profile)
    aimed = F.col("addressee").isNotNull()
    target = F.when(aimed, F.col("__other")).otherwise(F.col("__holder"))
    edge = _edge(F.when(aimed, "address").otherwise("interruption"), "__source", target)
    return rows.select(*rest, "span_no", "event_no", *edge, F.col("__holder.label").alias("floor_holder"), F.col("__holder.id").alias("floor_holder_id"), "quote")


def address_edges(lines: DataFrame, people: DataFrame, profile: Profile = HUNGARIAN) -> DataFrame:
    """Edges of lines (cycle, line_no, text) in which one member addresses another by name.

    Both ends are in the line itself, so cycles without speeches have edges
    too; without people of their cycle their ends are names alone.
    """
    rows = classified(split_lines(lines.select("cycle", "line_no", "text"), "text", profile), profile)
    rows = _named(rows.where("interjector IS NOT NULL AND addressee IS NOT NULL"), people, {"__source": "interjector", "__target": "addressee"}, profile)
    return rows.select("cycle", "line_no", "event_no", *_edge(F.lit("address"), "__source", F.col("__target")), "quote", F.col("segment").alias("text"))


def heckle_graph(edges: DataFrame, order: tuple[str, ...] = ("speech_uid", "span_no", "event_no"), drop_self_loops: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the directed graph of each cycle.

    Links (cycle, src, dst, weight) count parallel edges. Nodes (cycle, id,
    label, faction, side, is_mp, resolved, given, targets, received, sources)
    have the attributes with which they are first seen, a source before its
    target, and their degrees.
    """
    rows = edges.where("NOT self_loop") if drop_self_loops else edges
    links = rows.groupBy("cycle", F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    kept = ("faction", "side", "is_mp", "resolved")
    end = lambda e, k: F.struct(F.lit(k).alias("k"), F.col(f"{e}_id").alias("id"), F.struct(F.col(e).alias("label"), *(F.col(f"{e}_{c}").alias(c) for c in kept)).alias("has"))
    ends = rows.select("cycle", F.struct(*order).alias("at"), F.explode(F.array(end("source", 0), end("target", 1))).alias("e"))
    gave = F.col("e.k") == 0
    nodes = ends.groupBy("cycle", "e.id").agg(F.min_by("e.has", F.struct("at", "e.k")).alias("has"), F.count_if(gave).alias("given"), F.count_if(~gave).alias("received"))
    out = lambda end, name: links.groupBy(F.col("cycle").alias("c"), F.col(end).alias("of")).agg(F.count(F.lit(1)).alias(name))
    for end_, name in (("src", "targets"), ("dst", "sources")):
        nodes = nodes.join(out(end_, name), (F.col("cycle") == F.col("c")) & (F.col("id") == F.col("of")), "left").drop("c", "of")
    nodes = nodes.na.fill(0, ["targets", "sources"])
    return nodes.select("cycle", "id", "has.*", "given", "targets", "received", "sources"), links


def cross_bench(edges: DataFrame, by: tuple[str, ...] = ("cycle",)) -> DataFrame:
    """(by..., known, within, across, across_share): edges between known sides; who interrupts their own speech counts as within."""
    known = F.col("source_side").isNotNull() & F.col("target_side").isNotNull()
    across = known & (F.col("source_side") != F.col("target_side"))
    out = edges.groupBy(*by).agg(F.count_if(known).alias("known"), F.count_if(across).alias("across"))
    return out.select(*by, "known", (F.col("known") - F.col("across")).alias("within"), "across", F.try_divide(F.col("across").cast("double"), F.col("known")).alias("across_share"))


def focused(graph: DataFrame, min_weight: int, kind: str | None = None) -> DataFrame:
    """Edges of ``min_weight`` or more, of one crossing if given."""
    rows = graph.where(F.col("weight") >= min_weight)
    return rows if kind is None else rows.where(F.col("crossing") == kind)
