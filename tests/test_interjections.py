"""From speeches to the graph of who interjects to whom."""

import pytest
from pyspark.sql import functions as F

from rostrum.operators import network

PERSON = "struct<person_id string, label string, faction string, office string, is_mp boolean>"


@pytest.fixture(scope="module")
def speeches(spark):
    kata, bela, denes = ("k", "Kis Kata", "TISZA", None, True), ("b", "Nagy Béla István", "Fidesz", None, True), ("d", "Vad Dénes", None, "miniszter", False)
    other = ("z", "Nagy Béla Zoltán", "Fidesz", None, True)
    rows = [
        (1, 43, kata, "Igen. (Nagy Béla István: Nem! - Dr. Vad Dénes: De!) Tovább (Taps.)", "a"),
        (2, 43, bela, "(Kis Kata: Hol?) (Kis Kata Vad Dénesnek: Ott.) (Nagy Béla István: Én beszélek.)", "b"),
        (3, 43, denes, "(Kata Kis: Na!) (Senki Sára: Itt vagyok.) (Közbeszólás az MSZP soraiból: Úgy van!)", "c"),
        (4, 42, other, "(Kis Kata: Más ciklus.) (Béla Nagy: Ki?)", "d"),
        (5, 42, ("b2", "Nagy Béla Ödön", "", "", True), "Semmi. (14.20) (Jobbik)", "e"),
        (6, 42, None, "(Nagy Béla Ödön: Kinek?)", "f"),
        (7, 42, other, None, "g"),
    ]
    return spark.createDataFrame(rows, f"speech_uid long, cycle int, speaker {PERSON}, text string, sitting string").repartition(3)


def test_edges(speeches):
    edges = network.heckles(speeches)
    got = {(r["speech_uid"], r["span_no"], r["event_no"]): r for r in edges.collect()}
    seen = {k: (r["edge_type"], r["source_id"], r["source_match"], r["target_id"], r["source_side"], r["target_side"], r["quote"]) for k, r in got.items()}
    assert seen == {
        (1, 0, 0): ("interruption", "b", "exact", "k", "opposition", "government", "Nem!"),
        (1, 0, 1): ("interruption", "d", "exact", "k", "government", "government", "De!"),
        (2, 0, 0): ("interruption", "k", "exact", "b", "government", "opposition", "Hol?"),
        (2, 1, 0): ("address", "k", "exact", "d", "government", "government", "Ott."),
        (2, 2, 0): ("interruption", "b", "exact", "b", "opposition", "opposition", "Én beszélek."),
        (3, 0, 0): ("interruption", "k", "tokens", "d", "government", "government", "Na!"),
        (3, 1, 0): ("interruption", "name:senki sara", "none", "d", None, "government", "Itt vagyok."),
        (4, 0, 0): ("interruption", "name:kis kata", "none", "z", None, "government", "Más ciklus."),
        (4, 1, 0): ("interruption", "name:bela nagy", "none", "z", None, "government", "Ki?"),  # two bear the name
        (6, 0, 0): ("interruption", "b2", "exact", "name:", None, None, "Kinek?"),
    }
    assert got[2, 2, 0]["self_loop"] and got[2, 1, 0]["floor_holder"] == "Nagy Béla István" and got[1, 0, 0]["sitting"] == "a"


def test_graph(speeches):
    edges = network.heckles(speeches)
    nodes, links = network.heckle_graph(edges)
    assert {(r["cycle"], r["src"], r["dst"]): r["weight"] for r in links.collect()}[43, "k", "d"] == 2
    by = {(r["cycle"], r["id"]): r for r in nodes.collect()}
    assert (by[43, "k"]["given"], by[43, "k"]["targets"], by[43, "k"]["received"], by[43, "k"]["sources"]) == (3, 2, 2, 2)
    assert by[43, "name:senki sara"]["label"] == "Senki Sára" and not by[43, "name:senki sara"]["resolved"] and by[42, "name:"]["label"] == ""
    loops = network.heckle_graph(edges, drop_self_loops=False)[1].where("src = dst").collect()
    assert [(r["src"], r["weight"]) for r in loops] == [("b", 1)]
    benches = {r["cycle"]: r for r in network.cross_bench(edges).collect()}
    assert (benches[43]["known"], benches[43]["within"], benches[43]["across"]) == (6, 4, 2) and benches[42]["across_share"] is None


def test_first_seen_attributes_stay(spark):
    row = lambda uid, side: (uid, 0, 0, 43, "a", "A", "X", side, True, True, "b", "B", "Y", "government", True, True, False)
    names = "speech_uid long, span_no int, event_no int, cycle int, source_id string, source string, source_faction string, source_side string, source_is_mp boolean, source_resolved boolean, target_id string, target string, target_faction string, target_side string, target_is_mp boolean, target_resolved boolean, self_loop boolean"
    nodes, _ = network.heckle_graph(spark.createDataFrame([row(9, "later"), row(2, "first"), row(5, "later")], names).repartition(3))
    assert {r["id"]: r["side"] for r in nodes.collect()} == {"a": "first", "b": "government"}


def test_lines_without_speeches(spark, speeches):
    lines = [(43, 0, "Kis Kata Vad Dénesnek: Üljön le!"), (41, 7, "Régi Rezső Volt Vilmának: Igen? - Derültség."), (43, 1, "Kis Kata: Nincs címzett.")]
    edges = network.address_edges(spark.createDataFrame(lines, "cycle int, line_no int, text string"), network.chamber_people(speeches))
    got = {(r["cycle"], r["line_no"]): (r["source_id"], r["target_id"], r["target"], r["target_resolved"], r["quote"]) for r in edges.collect()}
    assert got == {(43, 0): ("k", "d", "Vad Dénes", True, "Üljön le!"), (41, 7): ("name:regi rezso", "name:volt vilma", "Volt Vilma", False, "Igen?")}


def test_nothing_gives_nothing(speeches):
    edges = network.heckles(speeches.where(F.lit(False)))
    nodes, links = network.heckle_graph(edges)
    assert edges.collect() == [] and nodes.collect() == [] and links.collect() == []
