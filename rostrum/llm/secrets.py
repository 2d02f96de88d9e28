"""Secret scans over a trigram inverted index.

DataFrame operations only. From each rule's regular expression a Boolean query
over trigrams is derived that every match must satisfy. The index lists, for
each trigram that some query asks for, the texts that contain it; its postings
are intersected and joined into candidates, and only candidates are run against
the rule. Rules that no trigram is mandatory for scan every text.

A text is known by a digest, so copies share postings and are verified once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

try:  # the parser of regular expressions has this name since Python 3.11
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre

#: Alternatives that a literal stretch of an expression may have before it is cut.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is written in what Java's and Python's expressions share; what
    ``group`` captures must have ``least`` characters, or the match is dropped
    (its characters stay used, as in a scan from left to right).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same as runs of any length of which short ones are dropped
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]{1,64}"),
)
RULES = BASE + ADDED


def _strings(node) -> set[str] | None:
    """All strings that a part of an expression can match, lower-cased, or None if they are too many."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 5 else None
    if name == "SUBPATTERN":
        return _all_strings(arg[-1])
    if name == "BRANCH":
        parts = [_all_strings(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 2:
        one = _all_strings(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _strings(node)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets that the lower-cased text of any match satisfies.

    The expression is cut into stretches that stand for few strings; a stretch
    whose strings all have three characters or more gives a disjunction, with
    the trigrams of each string. No stretch of that kind gives ``[]``, which
    holds for every text: such a rule scans fully. What stands under a look-
    around, or may be left out, is passed over.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clause = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((c for c in clause if not any(d < c for d in clause)), key=sorted))

    def walk(nodes) -> None:
        held = {""}
        for node in nodes:
            one = _strings(node)
            if one is not None and len(held) * len(one) <= MOST_STRINGS:
                held = {a + b for a in held for b in one}
                continue
            close(held)
            held = one if one is not None and len(one) <= MOST_STRINGS else {""}
            name = str(node[0])
            if one is None and name == "SUBPATTERN":
                walk(node[1][-1])
            elif one is None and name in ("MAX_REPEAT", "MIN_REPEAT") and node[1][0] >= 1:
                walk(node[1][2])
        close(held)

    walk(sre.parse(pattern))
    return clauses


def text_key(text: Column) -> Column:
    """The digest by which equal texts share postings; null and empty texts are alike."""
    return F.md5(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The inverted index (trigram, key): which texts contain which of the trigrams that the rules ask for.

    Each text is lower-cased once and searched for each trigram; a posting is
    a row, so no list grows with the corpus. Copies give equal postings, which
    are put together.
    """
    wanted = sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})
    rows = docs.select(text_key(F.col(text)).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted)))
    return rows.select("key", F.explode(found).alias("trigram")).distinct().select("trigram", "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the texts that satisfy the queries of some indexed rules, and which.

    Postings of a text meet in one set of trigrams, at most as many as the
    rules ask for; a query is then a test of that set.
    """
    met = index.groupBy("key").agg(F.collect_set("trigram").alias("has"))
    tests = []
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        if not clauses:
            continue
        fits = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for option in clause:
                every = F.lit(True)
                for t in sorted(option):
                    every = every & F.array_contains("has", t)
                some = some | every
            fits = fits & some
        tests.append(F.when(fits, F.lit(rule.kind)))
    kinds = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return met.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches in code points, the end exclusive.

    The matches and the stretches between them have the same lengths as they
    take turns in the text, so running sums of their lengths are the places.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    sizes = F.zip_with(found, held, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("held")))
    steps = F.zip_with(sizes, gaps, lambda m, g: F.struct(m["n"].alias("n"), m["held"].alias("held"), g.alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, m):
        first = acc["at"] + m["gap"]
        last = first + F.coalesce(m["n"], F.lit(0))
        span = F.struct(first.alias("start"), last.alias("end"))
        keep = m["n"].isNotNull() & (m["held"] >= rule.least)
        return F.struct(last.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step)["out"]).otherwise(none)


def _tagged(text: Column, rules) -> Column:
    """array<struct<start, kind, end>> of all the rules; ``kind`` is the rule's place in the list."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def tag(rule: Rule, k: int) -> Column:
        return F.transform(spans(text, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    return F.concat(none, *(tag(r, k) for k, r in rules))


def scanned(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, end, kind>> by start, then kind in the order of ``rules``.

    All columns are kept but one named ``secrets``, which is replaced. Null and
    empty texts have no secrets. Copies and repeated rows agree. The texts are
    scanned once for the index and the rules without trigrams, and once for
    the candidates, which a join on their digests picks; Spark sends the
    candidates to all tasks if they are few, and else filters and deals out.
    """
    numbered = list(enumerate(rules))
    full = [(k, r) for k, r in numbered if not trigram_query(r.pattern)]
    indexed = [(k, r) for k, r in numbered if trigram_query(r.pattern)]
    home = shared_dir(docs.sparkSession)
    index = stored(build_index(docs, [r for _, r in indexed], text), f"{home}/index")
    picked = stored(candidates(index, [r for _, r in indexed]), f"{home}/candidates")

    texts = docs.select(text_key(F.col(text)).alias("__key"), F.col(text).alias("__text"))
    checked = texts.join(picked.withColumnRenamed("key", "__at"), F.col("__key") == F.col("__at"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [F.when(F.array_contains("kinds", r.kind), _tagged(F.col("__text"), [(k, r)])).otherwise(none) for k, r in indexed]
    checked = checked.select("__key", F.concat(none, *parts).alias("__some")).where(F.size("__some") > 0)
    # written before copies are put together: so the join may split a text of very many copies
    checked = stored(checked, f"{home}/found")
    checked = stored(checked.groupBy("__key").agg(F.first("__some").alias("__some")), f"{home}/checked")

    kept = [c for c in docs.columns if c != "secrets"]
    own = F.coalesce(F.col(text), F.lit(""))
    hits = [F.when(F.rlike(own, F.lit(r.pattern)), _tagged(own, [(k, r)])).otherwise(none) for k, r in full]
    # a row travels as one value, so its columns may have any names
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text_key(F.col(text)).alias("text_key"), F.concat(none, *hits).alias("full"))
    rows = rows.join(checked, F.col("text_key") == F.col("__key"), "left")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    every = F.array_sort(F.concat("full", F.coalesce("__some", none)))
    named = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind")))
    return rows.select("row.*", named.alias("secrets"))


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def brute_force(text: str | None, rules=RULES) -> list[tuple[int, int, str]]:
    """The same for one text with Python's expressions: what tests compare with."""
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return [(a, b, rules[k].kind) for a, k, b in sorted(out)]
