"""Text as columns: words, salutations, name keys, spans. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import HUNGARIAN, Profile

WORD = r"\p{L}+"


def _bases() -> tuple[str, str]:
    """Latin letters with marks and the letters that are left without them, in the same order."""
    marked = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    bare = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in marked]
    pairs = [(c, b) for c, b in zip(marked, bare, strict=True) if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _bases()


def composed(text: Column) -> Column:
    """Letters and their marks as single characters (NFC), an Arrow batch at a time. For lists and names; corpora are taken as composed."""
    return F.udf(lambda t: None if t is None else unicodedata.normalize("NFC", t), "string", useArrow=True)(text)


def unmarked(text: Column) -> Column:
    """Latin letters without their marks, be these part of the letter or characters of their own; in the JVM."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), r"\p{M}+", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def whitespace_words(text: Column) -> Column:
    """How many runs of other than white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def has_text(text: Column) -> Column:
    """Not null and more than white space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != ""


def without_soft_hyphens(text: Column) -> tuple[Column, Column]:
    """(text without U+00AD, how many there were)."""
    bare = F.replace(text, F.lit("­"), F.lit(""))
    return bare, F.length(text) - F.length(bare)


def without_salutation(text: Column, profile: Profile = HUNGARIAN, max_words: int = 60) -> tuple[Column, Column]:
    """(text without its opening salutation, words removed).

    Nothing is removed if the salutation has more than ``max_words`` words or
    nothing would be left.
    """
    head = F.regexp_extract(text, "(?iu)" + profile.salutation, 0)
    n, rest = whitespace_words(head), F.substring(text, F.length(head) + 1, F.length(text))
    strip = (n > 0) & (n <= max_words) & has_text(rest)
    return F.when(strip, F.trim(rest)).otherwise(text), F.when(strip, n).otherwise(F.lit(0))


def name_key(name: Column, profile: Profile = HUNGARIAN) -> Column:
    """A name without title, initial, marks and case, single-spaced."""
    bare = F.regexp_replace(name, rf"(?iu)^\s*(?:{profile.honorifics})\.?\s+", "")
    bare = F.regexp_replace(bare, r"^\s*\p{Lu}\.\s+", "")
    bare = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return F.lower(unmarked(bare))


def letters(word: Column, profile: Profile = HUNGARIAN) -> Column:
    """Letters, those that the language writes with several characters counting once."""
    low = F.lower(word)
    return F.length(F.regexp_replace(low, "|".join(profile.digraphs), "x") if profile.digraphs else low)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def joined_set(values: Column, mark: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), mark)


def first_match(text: Column, cues: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The name of the first cue whose expression is found in the text."""
    tests = reversed([(name, F.rlike(text, F.lit(f"(?U){pattern}"))) for name, pattern in cues])
    return reduce(lambda rest, t: F.when(t[1], F.lit(t[0])).otherwise(rest), tests, F.lit(default).cast("string"))


def all_matches(text: Column, cues: tuple[tuple[str, str], ...], flags: str = "(?U)") -> Column:
    """The names of all cues that are found, in their order."""
    if not cues:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(f"{flags}{p}")), F.lit(n)) for n, p in cues)))


def spans(text: Column, opening: str = r"\(", closing: str = r"\)") -> Column:
    """What stands in brackets, innermost ones."""
    return F.regexp_extract_all(text, F.lit(f"{opening}([^{opening}{closing}]*){closing}"), F.lit(1))


def is_remark(span: Column) -> Column:
    """Not a bare capitalised word of up to 15 letters, a time, or a number."""
    return ~F.rlike(span, F.lit(r"^\s*(?:\p{Lu}[\p{L}\p{N}_-]{0,14}|[0-9.:]+)\s*$"))


def ngram_order(token: Column, mark: str = "#") -> Column:
    if not mark:
        raise ValueError("the delimiter must not be empty")
    return F.size(F.split(token, rf"\Q{mark}\E"))


def decoded_whitespace(cell: Column) -> Column:
    """A cell of JSON-escaped white space; what is no JSON is taken without its quotes."""
    wrapped = F.from_json(F.concat(F.lit('{"v":'), cell, F.lit("}")), "v string")["v"]
    return F.coalesce(wrapped, F.regexp_replace(cell, '^"|"$', ""))


def case_stripped(word: Column) -> Column:
    """A name without the ending that marks an addressee, a long last vowel shortened; null without one."""
    suffix = r"(?iu)(nak|nek|hoz|hez|höz|tól|től|ról|ről|nál|nél)$"
    stem = F.regexp_replace(word, suffix, "")
    last = F.translate(F.substring(stem, -1, 1), "áé", "ae")
    whole = F.concat(F.substring(stem, F.lit(1), F.length(stem) - 1), last)
    return F.when(F.rlike(word, F.lit(suffix)) & (F.length(stem) > 1), whole)
