"""The token table, on which all other operators work.

``tokens(doc_id, sent_id, pos, token)``: one row a token, positions counted
from 0 in the document. Tables of annotators have form, lemma, xpostag, head
and more in place of token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..profile import Profile
from ..functions.arrays import let
from ..functions.text import WORD

SENTENCE_END = r"[.!?]+"
CONTENT = ("N", "V", "Adj", "Adv")


def tokenized(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., sent_id, pos, token): lower-cased words with the number of their sentence.

    Sentences end in runs of full stops, exclamation and question marks. Null
    and wordless texts give no rows. Positions come from the arrays
    themselves, so nothing is shuffled.
    """
    sentences = F.transform(
        F.split(F.lower(F.col(text)), SENTENCE_END),
        lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), lambda w: F.struct(i.alias("sent_id"), w.alias("token"))),
    )
    rows = docs.select(*keys, F.posexplode(F.flatten(sentences)).alias("pos", "t"))
    return rows.select(*keys, F.col("t.sent_id").alias("sent_id"), "pos", F.col("t.token").alias("token"))


def listed(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., sentences): each document's sentences as arrays of lower-cased words, one row a document.

    The shape for work that stays inside a document: nothing is shuffled
    until what is left of it is counted. Null texts have no sentences.
    """
    cut = F.transform(F.split(F.lower(F.col(text)), SENTENCE_END), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    return docs.select(*keys, F.coalesce(cut, F.array().cast("array<array<string>>")).alias("sentences"))


def by_sentence(lists: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., sent_id, tokens): a row for each sentence that has words, of ``listed`` documents."""
    return lists.select(*keys, F.posexplode("sentences").alias("sent_id", "tokens")).where(F.size("tokens") > 0)


def words_and_types(lists: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., token, once): a row for each word of ``listed`` documents, and one marked ``once`` for each distinct word.

    So words and types are counted in one aggregation by document.
    """
    marked = lambda words, once: F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(once).alias("once")))
    return lists.select(*keys, F.inline(let(F.flatten("sentences"), lambda w: F.concat(marked(w, False), marked(F.array_distinct(w), True)))))


def main_category(tag: Column) -> Column:
    """The category of a tag such as ``[/N|Pro][Nom]``; null for other tags."""
    inside = F.nullif(F.regexp_extract(tag, r"^\[/([^\]]*)\]", 1), F.lit(""))
    return F.split(inside, r"\|")[0]


def subcategories(tag: Column) -> Column:
    inside = F.regexp_extract(tag, r"^\[/([^\]]*)\]", 1)
    return F.slice(F.split(inside, r"\|"), 2, 100)


def is_content(tag: Column, keep: tuple[str, ...] = CONTENT, drop_pronouns: bool = True) -> Column:
    wanted = F.coalesce(main_category(tag).isin(*keep), F.lit(False))
    return wanted & ~F.array_contains(subcategories(tag), "Pro") if drop_pronouns else wanted


def is_punctuation(tag: Column) -> Column:
    """A tag without a category that names punctuation."""
    return F.coalesce(main_category(tag).isNull() & F.contains(tag, F.lit("Punct")), F.lit(False))


def is_bracketed_punctuation(tag: Column) -> Column:
    """A tag that begins with a bracket and names punctuation, whatever its category."""
    return F.coalesce(F.startswith(tag, F.lit("[")) & F.contains(tag, F.lit("Punct")), F.lit(False))


def names_punctuation(tag: Column) -> Column:
    """A tag that names punctuation anywhere."""
    return F.coalesce(F.contains(tag, F.lit("Punct")), F.lit(False))


def is_truncated(n_tokens: Column, most: int = 512) -> Column:
    """Whether a model that takes ``most`` tokens sees only part of a text; unknown lengths are not."""
    return F.coalesce(n_tokens > most, F.lit(False))


def repaired(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Tokens with the lemma and tag that the profile fixes for a form, and ``repaired``, whether that changed them."""
    if not profile.proper_nouns:
        return tokens.withColumn("repaired", F.lit(False))
    fixed = F.create_map(*(F.lit(x) for form, (lemma, tag) in profile.proper_nouns.items() for x in (form, f"{lemma}\t{tag}")))
    to = F.split(F.get(F.array(fixed[F.col("form")]), 0), "\t")
    changed = to.isNotNull() & ((to[0] != F.col("lemma")) | (to[1] != F.col("xpostag")))
    return tokens.withColumns({"lemma": F.coalesce(to[0], F.col("lemma")), "xpostag": F.coalesce(to[1], F.col("xpostag")), "repaired": F.coalesce(changed, F.lit(False))})


def lemma_sentences(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Tokens repaired, without punctuation and blank lemmas, positions closed up in each sentence."""
    kept = repaired(tokens, profile).where(~is_punctuation(F.col("xpostag")) & (F.trim(F.coalesce("lemma", F.lit(""))) != ""))
    place = F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("pos")) - 1
    return kept.withColumn("place", place)


def repairs(tokens: DataFrame, profile: Profile) -> DataFrame:
    """One row (n_tokens, n_repaired, n_punctuation, n_blank): what ``lemma_sentences`` changes and leaves out."""
    mark, blank = is_punctuation(F.col("xpostag")), F.trim(F.coalesce("lemma", F.lit(""))) == ""
    counts = {"n_repaired": F.col("repaired"), "n_punctuation": mark, "n_blank": blank & ~mark}
    return repaired(tokens, profile).agg(F.count(F.lit(1)).alias("n_tokens"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def streams(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_content, n_sentences) in one pass; sentences of punctuation alone count."""
    word = ~is_punctuation(F.col("xpostag")) & (F.trim(F.coalesce("form", F.lit(""))) != "")
    return tokens.groupBy("doc_id").agg(
        F.count_if(word).alias("n_words"),
        F.count_if(word & is_content(F.col("xpostag"))).alias("n_content"),
        F.count_distinct("sent_id").alias("n_sentences"),
    )


def without_stopwords(tokens: DataFrame, stopwords: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that are not in ``stopwords`` (token)."""
    return tokens.join(stopwords.select(F.col("token").alias("__stop")), F.col(token) == F.col("__stop"), "left_anti")


def reconstructs(tokens: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, ok): whether forms and the white space after them spell the text again."""
    spelled = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("form", F.coalesce("wsafter", F.lit(""))).alias("s")))).alias("all"))
    spelled = spelled.select("doc_id", F.array_join(F.col("all.s"), "").alias("spelled"))
    return body.join(spelled, "doc_id", "left").select("doc_id", (F.coalesce("spelled", F.lit("")) == F.coalesce("text", F.lit(""))).alias("ok"))
