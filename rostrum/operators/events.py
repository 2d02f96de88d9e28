"""Chamber events: parenthetical lines split into events and classified by cues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import rate, ratio
from ..functions.text import all_matches, case_stripped, first_match, has_text, is_remark, spans
from ..profile import HUNGARIAN, LOWER, UPPER, Profile
from ..storage import stored
from .ordering import running


def segments(line: Column, profile: Profile = HUNGARIAN) -> Column:
    """The events of a line, in order: parted by dashes between spaces, then at sentence ends.

    A sentence that ends in an abbreviation or an initial goes on in the next.
    """
    short = "|".join(profile.abbreviations)
    goes_on = rf"(?iu)(?:^|\s)(?:{short}|\p{{L}})\.$"
    parts = F.filter(F.split(line, r"\s+[-–—]\s+"), lambda p: F.trim(p) != "")

    def sentences(part: Column) -> Column:
        pieces = F.split(part, rf"(?<=[.!?])\s+(?=[{UPPER}])")

        def step(acc, s):
            held = F.try_element_at(acc, F.lit(-1))
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(held, F.lit(" "), s)))
            return F.when((F.size(acc) > 0) & F.rlike(held, F.lit(goes_on)), joined).otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(pieces, F.array().cast("array<string>"), step)

    return F.transform(F.filter(F.flatten(F.transform(parts, sentences)), lambda s: F.trim(s) != ""), lambda s: F.trim(s))


def split_lines(lines: DataFrame, line: str = "text", profile: Profile = HUNGARIAN) -> DataFrame:
    """A row for each event of each line: all columns, event_no from 0, and segment."""
    return lines.select("*", F.posexplode(segments(F.col(line), profile)).alias("event_no", "segment"))


def audiences(segment: Column, profile: Profile = HUNGARIAN) -> tuple[Column, Column]:
    """(audiences, parties) that a segment names; sides without regard to case, parties with it."""
    sides = (("government", profile.government), ("opposition", profile.opposition), ("house", profile.house))
    parties = all_matches(segment, profile.parties)
    named = all_matches(segment, sides, "(?iuU)")
    party = F.when(F.size(parties) > 0, F.array(F.lit("party"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.concat(named, party)), F.array_sort(parties)


def classified(events: DataFrame, profile: Profile = HUNGARIAN, segment: str = "segment") -> DataFrame:
    """Adds kind, kinds, intensity, weight, audiences, parties, interjector, addressee and quote.

    A named interjection is two to four capitalised words before a colon, with
    or without title and initial, that don't name a reaction or a bench; its
    kind is ``interjection`` and it has no other audience. Other segments get
    the first cue found in what is before a colon, or ``other``.
    """
    s = F.col(segment)
    title = rf"^\s*(?:(?i:{profile.honorifics})\.\s*)?(?:[{UPPER}]\.\s*)?"
    person = rf"{title}((?:[{UPPER}][{LOWER}-]+\s+){{1,3}}[{UPPER}][{LOWER}-]+):\s+(.+)$"
    name = F.nullif(F.regexp_extract(s, person, 1), F.lit(""))
    not_named = F.rlike(name, F.lit(f"(?iuU){profile.not_a_person}"))
    named = name.isNotNull() & ~not_named
    head = F.regexp_extract(s, r"^([^:]{1,90}):\s+(.+)$", 1)
    low = F.lower(s)
    reacting = F.rlike(F.lower(head), F.lit("(?U)" + "|".join(p for _, p in profile.reactions)))
    quote = F.when(named, F.regexp_extract(s, person, 2)).when((head != "") & reacting, F.regexp_extract(s, r"^[^:]{1,90}:\s+(.+)$", 1))
    cue_text = F.when(quote.isNotNull() & ~named, F.lower(head)).otherwise(low)
    kinds = F.when(named, F.array(F.lit("interjection"))).otherwise(all_matches(cue_text, profile.reactions))
    kind = F.when(named, F.lit("interjection")).otherwise(first_match(cue_text, profile.reactions, "other"))
    counted = ~kind.isin("other", "interjection")
    intensity = F.when(counted, first_match(cue_text, profile.intensities, "plain")).otherwise(F.lit("plain"))
    found, parties = audiences(s, profile)
    nobody = F.array().cast("array<string>")
    aimed = F.when(named, nobody).when(counted & (F.size(found) == 0), F.array(F.lit("unspecified"))).otherwise(found)
    names = F.split(F.trim(name), r"\s+")
    stem = case_stripped(F.element_at(names, -1))
    split = named & (F.size(names) >= 4) & stem.isNotNull()
    half = F.size(names) - 2
    weights = F.create_map(*(F.lit(x) for pair in profile.weights.items() for x in pair))
    out = events.withColumns({"kind": kind, "kinds": kinds, "intensity": intensity, "audiences": aimed, "parties": F.when(named, nobody).otherwise(parties), "quote": quote})
    out = out.withColumns(
        {
            "interjector": F.when(split, F.array_join(F.slice(names, F.lit(1), half), " ")).when(named, F.array_join(names, " ")),
            "addressee": F.when(split, F.concat_ws(" ", F.element_at(names, -2), stem)),
        }
    )
    return out.withColumn("weight", F.coalesce(weights[F.col("intensity")], F.lit(1.0)))


def side_of(party: Column, cycle: Column, profile: Profile = HUNGARIAN) -> Column:
    """government or opposition; an unknown cycle fails."""
    governs = reduce(lambda rest, g: F.when(cycle == g[0], party.isin(*g[1])).otherwise(rest), profile.governing.items(), F.raise_error(F.concat(F.lit("unknown cycle "), cycle.cast("string"))).cast("boolean"))
    return F.when(governs, F.lit("government")).otherwise(F.lit("opposition"))


def audience_label(found: Column, sides: Column) -> Column:
    """One label: named sides first, then the parties' side or ``both``, the house, or ``unspecified``."""
    distinct = F.array_distinct(sides)
    return (
        F.when(F.array_contains(found, "government") & F.array_contains(found, "opposition"), "both")
        .when(F.array_contains(found, "government"), "government")
        .when(F.array_contains(found, "opposition"), "opposition")
        .when(F.size(distinct) == 1, F.element_at(distinct, 1))
        .when(F.size(distinct) > 1, "both")
        .when(F.array_contains(found, "house"), "house")
        .otherwise("unspecified")
    )


def summary(events: DataFrame, lines: DataFrame, by: tuple[str, ...] = ("cycle",), kinds: str = "kinds") -> DataFrame:
    """(by..., kind, audience, events, weighted, per_1000_lines): an event counts for each of its kinds.

    ``lines`` has by and n_lines.
    """
    each = events.select(*by, F.explode(kinds).alias("kind"), "audience", "weight")
    counts = each.groupBy(*by, "kind", "audience").agg(F.count(F.lit(1)).alias("events"), F.sum("weight").alias("weighted"))
    return counts.join(lines, list(by)).withColumn("per_1000_lines", rate(F.col("events"), F.col("n_lines"), 1000.0)).drop("n_lines")


def ranked(rows: DataFrame, by: str, who: str, label: str = "ALL") -> DataFrame:
    """(by, who, n, share, rank) for each value of ``by`` and for all together; null names are left out.

    Ranks are places in ranges of (by, n, who), so no task orders all names.
    """
    rows = rows.where(F.col(who).isNotNull())
    sets = rows.groupingSets([[F.col(by), F.col(who)], [F.col(who)]], F.col(by), F.col(who)).agg(F.count(F.lit(1)).alias("n"), F.grouping(F.col(by)).alias("__all"))
    out = sets.select(F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(by).cast("string")).alias(by), who, "n")
    out = stored(running(out, [F.col(by), -F.col("n"), F.col(who)], {"__ahead": F.lit(1)}))
    whole = out.groupBy(F.col(by).alias("__of")).agg(F.min("__ahead").alias("__start"), F.sum("n").alias("__all"))
    out = out.join(whole, F.col(by).eqNullSafe(F.col("__of")))
    return out.select(by, who, "n", ratio(F.col("n"), F.col("__all")).alias("share"), (F.col("__ahead") - F.col("__start") + 1).cast("int").alias("rank"))


def speaker_scores(events: DataFrame, totals: DataFrame, kinds: list[str]) -> DataFrame:
    """(speaker, a count for each kind, weighted, own, other, unattributed, rates) joined to totals (speaker, n_words, minutes, speeches).

    One conditional aggregation over events (speaker, kinds, weight,
    own_side, audience); speakers without events have zeros.
    """
    has = lambda k: F.array_contains("kinds", k)
    sums = events.groupBy("speaker").agg(
        *(F.count_if(has(k)).alias(k) for k in kinds), F.sum("weight").alias("weighted"),
        F.count_if(F.col("audience") == F.col("own_side")).alias("own"),
        F.count_if(F.col("audience").isin("government", "opposition") & (F.col("audience") != F.col("own_side"))).alias("other"),
        F.count_if(~F.col("audience").isin("government", "opposition")).alias("unattributed"),
    )
    out = totals.join(sums, "speaker", "left").na.fill(0)
    rates = {f"{k}_per_1000_words": rate(F.col(k), F.col("n_words"), 1000.0) for k in kinds} | {f"{k}_per_minute": ratio(F.col(k), F.col("minutes")) for k in kinds}
    return out.withColumns(rates)


def floor_events(speeches: DataFrame, text: str = "text", profile: Profile = HUNGARIAN) -> DataFrame:
    """A row for each classified event that a speech's brackets hold, with the speech's other columns and ``audience``: it goes to who has the floor.

    ``speeches`` has text and cycle. Bare capitalised words, times and numbers
    in brackets are no remarks; events of no known kind are left out. Remarks
    are formulas that come again and again: each distinct one is classified
    once and written, so that Spark can send them to the speeches if they are
    few.
    """
    rest = [c for c in speeches.columns if c != text]
    rows = speeches.select(*rest, F.explode(spans(F.col(text))).alias("span"))
    each = rows.select(F.col("span").alias("__span")).distinct()
    each = split_lines(each.where(has_text(F.col("__span")) & is_remark(F.col("__span"))), "__span", profile)
    each = stored(classified(each, profile).where("kind <> 'other'"))
    rows = rows.join(each, F.col("span") == F.col("__span")).drop("__span")
    sides = F.transform("parties", lambda p: side_of(p, F.col("cycle"), profile))
    return rows.withColumn("audience", audience_label(F.col("audiences"), sides))


def own_side(faction: Column, office: Column, cycle: Column, profile: Profile = HUNGARIAN) -> tuple[Column, Column]:
    """(side, side_source): by the faction, or else government by an office, or else none."""
    by_faction, by_office = F.coalesce(faction != "", F.lit(False)), F.coalesce(F.trim(office) != "", F.lit(False))
    side = F.when(by_faction, side_of(faction, cycle, profile)).when(by_office, "government")
    return side, F.when(by_faction, "faction").when(by_office, "office").otherwise("none")


def floor_totals(speeches: DataFrame, keys: tuple[str, ...] = ("speaker", "faction")) -> DataFrame:
    """(keys..., speeches, words, minutes, office): what reactions are measured against. Speeches have n_words, duration_s and office."""
    return speeches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("speeches"), F.sum("n_words").alias("words"),
        F.round(F.sum("duration_s") / 60, 2).alias("minutes"), F.max("office").alias("office"),
    )


def floor_scores(events: DataFrame, totals: DataFrame, benches: tuple[str, ...] = ("laughter", "applause"), kinds: tuple[str, ...] = ("laughter", "applause", "heckling", "uproar", "noise"), min_speeches: int = 5) -> DataFrame:
    """``totals`` with what each speaker drew: counts and weights by kind, which benches responded, and rates.

    ``events`` has speaker, kinds, weight and audience, ``totals`` speaker,
    side, speeches, words and minutes. Heckles are others' doing and are
    ``heckles_received``. Own and other side are 0 for speakers of no side;
    what no bench is named for is ``unattributed``. Speakers below
    ``min_speeches`` are flagged, not dropped. One aggregation by speaker.
    """
    name = lambda k: "heckles_received" if k == "heckling" else k
    has, from_ = (lambda k: F.array_contains("kinds", k)), ("government", "opposition", "unspecified")
    sums = events.groupBy("speaker").agg(
        *(F.count_if(has(k)).alias(name(k)) for k in kinds),
        *(F.round(F.sum(F.when(has(k), F.col("weight"))), 2).alias(f"{name(k)}_weighted") for k in kinds),
        *(F.count_if(has(k) & (F.col("audience") == side)).alias(f"{k}_from_{side}") for k in benches for side in from_),
    )
    out = totals.join(sums, "speaker", "left").na.fill(0, [c for c in sums.columns if c != "speaker"])
    side = F.col("side")
    for k in benches:
        gov, opp = F.col(f"{k}_from_government"), F.col(f"{k}_from_opposition")
        own, other = (F.when(side == "government", a).when(side == "opposition", b).otherwise(0) for a, b in ((gov, opp), (opp, gov)))
        out = out.withColumns({f"{k}_own_side": own, f"{k}_other_side": other, f"{k}_unattributed": F.col(k) - own - other})
        out = out.withColumns({f"{k}_per_speech": F.round(ratio(F.col(k), F.col("speeches")), 4), f"{k}_per_1000_words": F.round(rate(F.col(k), F.col("words"), 1000.0), 3), f"{k}_per_minute": F.round(ratio(F.col(k), F.col("minutes")), 4)})
    return out.withColumn("below_min_speeches", F.col("speeches") < min_speeches)
