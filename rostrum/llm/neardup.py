"""Near-duplicates by BagMinHash signatures of word shingles.

A text is the multiset of its shingles of five words; two texts are linked if
the weighted Jaccard similarity of their multisets is 0.8 or more, and linked
texts, in however many steps, are one class. Copies share a digest and are one
text throughout.

1. Signatures are cut into bands; texts that agree in a band meet in a bucket.
2. In each bucket the text that meets most others is the hub, and every other
   member is held against it: as many pairs as members. The text that a family
   was copied from is in all the largest buckets, so hubs link nearly all.
3. Links make classes, by passing the smallest label along them.
4. Hubs of one class are then as one, the largest of them standing for all,
   and those whose members are still of several classes are settled exactly.
   Members that are linked, though one of them is not linked to the hub, must
   share a part of what tells them from the hub, so they meet under an element
   of that (see ``_differences``); changes made at random are hardly ever
   shared, so members meet few others. Members of a hub that fit one block
   (4,096 texts) meet in that, each once. Of more than that, those that share
   an element are held in such blocks while the others stream past: there the
   rows that are sent grow with the square of a family by the block's size.
   Nothing but links comes out, so no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import band_keys, signatures
from .common import batches_of, shared_dir, spare, stored
from .shingles import bags, mix, slices

#: 24 bands of 4 registers: two texts of similarity 0.8 share no band once in 300,000 times.
BANDS, ROWS = 24, 4
SIMILARITY = 0.8
#: Texts that are held against one copy of a hub; that a block holds; that stream past one block.
PART, QUERIES, STREAM = 256, 4096, 20_000
#: Elements that a block holds, or those of one text that has more.
HELD = 1 << 20
#: What rows of blocks carry.
_PAYLOAD = ("role", "key", "label", "size", "elements", "weights")


def with_key(docs: DataFrame, name: str = "__key") -> DataFrame:
    """Adds the digest of the text, under a name that the table lacks; null counts as empty."""
    return docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _registers(texts: list[str]) -> np.ndarray:
    return signatures(*bags(texts), BANDS * ROWS)


def _signed(keyed: DataFrame) -> DataFrame:
    """(key, bands): the bands of each distinct text of one word or more."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(batch["key"]):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            keys, texts = ([batch[c].iloc[i] for i in new] for c in ("key", "text"))
            for a, b in slices(texts):
                registers = _registers(texts[a:b])
                full = np.flatnonzero((registers != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1))
                if len(full):  # pandas gives columns without rows a type that is no list
                    yield pd.DataFrame({"key": [keys[a + i] for i in full], "bands": list(band_keys(registers[full], BANDS, ROWS))})

    rows = keyed.select(F.col("__key").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(sign, "key binary, bands array<long>")


def _similarity(common: float, a: float, b: float) -> float:
    return float(common / (a + b - common))


def _links(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between hubs and the texts that are held against them.

    ``rows`` has grp, role (0: the hub, 1: a member), key and text. Rows of a
    group lie together, the hub first.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hub, members in _against_hubs(batches):
            out = [(hub.key, m.key) for m in members if _similarity(hub.common(m.h, m.w), hub.size, m.w.sum()) >= similarity]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "role")
    return dealt.mapInPandas(compare, "a binary, b binary").distinct()


class _Hub:
    """A text that others are held against."""

    def __init__(self, key: bytes, h: np.ndarray, w: np.ndarray):
        self.key, self.h, self.w, self.size = key, h, w, int(w.sum())

    def weights(self, h: np.ndarray) -> np.ndarray:
        """How often the hub has each of the shingles ``h``."""
        place = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[place] == h, self.w[place], 0)

    def common(self, h: np.ndarray, w: np.ndarray) -> int:
        return int(np.minimum(self.weights(h), w).sum())


@dataclass
class _Member:
    key: bytes
    label: bytes
    h: np.ndarray
    w: np.ndarray


def _against_hubs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Hub, list[_Member]]]:
    """Each hub with some of its members, a slice of bounded text at a time."""
    hub, group = None, None
    for batch in (batch.iloc[a:b] for batch in batches for a, b in slices(batch["text"].tolist())):
        h, w, n = bags(batch["text"].tolist())
        at, held = np.r_[0, np.cumsum(n)], []
        for k, (grp, role, key, label) in enumerate(zip(batch["grp"], batch["role"], batch["key"], batch["label"], strict=True)):
            own = slice(at[k], at[k + 1])
            if role == 0:
                if held:
                    yield hub, held
                hub, group, held = _Hub(key, h[own].copy(), w[own].copy()), grp, []
            else:
                assert grp == group, "a member came before its hub"
                held.append(_Member(key, label, h[own], w[own]))
        if held:
            yield hub, held


DIFFERENCES = "hub binary, kind int, key binary, label binary, outside boolean, size long, elements array<long>, weights array<long>, tokens array<long>, rest array<long>"


def _differences(rows: DataFrame, similarity: float) -> DataFrame:
    """How members differ from the hub that stands for theirs, and the tokens under which they must meet to be linked.

    Let x and y be members of a hub h, one of them not linked to it, and c =
    (1 - t) / (1 + t) for the similarity t. The two are linked if their
    multisets differ by c(|x| + |y|) at most, and what they differ by is
    |Dx| + |Dy| less twice what the differences Dx and Dy from the hub have in
    common, so these must share f(x) + f(y) at least, where f(x) = (|Dx| -
    c|x|) / 2. One that is not linked has f > c|h| / 2, so the shared part is
    never empty and every member knows a least size for its own. By the prefix
    principle two differences that share so much share one of their first
    elements in a fixed order, of which each side takes as many as leave less
    than that size over. What a member adds comes before what it lacks: texts
    that were changed at random share hardly any of it.

    kind 0: ``elements`` are the differences. A member that is linked to the
    hub takes the tokens that a partner that isn't calls for. One that isn't
    has those as well, and ``rest``, by which it meets linked ones only. By
    the triangle inequality it meets none if its similarity to the hub is
    below 2t - 1, and below 3t - 2 no other that could.
    kind 1: members below 2t - 1, for meeting each other: ``elements`` are all
    shingles, those that the hub lacks first, and the shared part is t|x|.
    """
    c, slack = (1 - similarity) / (1 + similarity), 1e-6
    turn = np.uint64(0xD1B54A32D192ED03)

    def first(w: np.ndarray, least: float) -> int:
        """How many elements to take so that those left over weigh less than ``least``."""
        left = w.sum() - np.cumsum(w)
        return int(np.searchsorted(-left, -(least - slack), "right")) + 1 if w.sum() >= least - slack else 0

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hub, members in _against_hubs(batches):
            out = []
            for m in members:
                size, there = int(m.w.sum()), hub.weights(m.h)
                like = _similarity(np.minimum(there, m.w).sum(), hub.size, size)
                outside = like < similarity
                if like >= 3 * similarity - 2 - slack:
                    place = np.minimum(np.searchsorted(m.h, hub.h), len(m.h) - 1)
                    lacks = hub.w - np.where(m.h[place] == hub.h, m.w[place], 0)
                    more, less = m.w > there, lacks > 0
                    elements = np.concatenate([m.h[more], mix(hub.h[less] ^ turn)])
                    weights = np.concatenate([(m.w - there)[more], lacks[less]])
                    f = (weights.sum() - c * size) / 2
                    upto = first(weights, f + c * hub.size / 2)
                    rest = first(weights, f - c * hub.size / 2) if outside and like >= 2 * similarity - 1 - slack else upto
                    out.append((0, m, outside, size, elements, weights, elements[:upto], elements[upto:rest]))
                if outside and like < 2 * similarity - 1 + slack:
                    order = np.argsort(there > 0, kind="stable")
                    elements, weights = m.h[order], m.w[order]
                    out.append((1, m, True, size, elements, weights, elements[: first(weights, similarity * size)], elements[:0]))
            yield pd.DataFrame(
                {
                    "hub": [hub.key] * len(out), "kind": [o[0] for o in out], "key": [o[1].key for o in out], "label": [o[1].label for o in out],
                    "outside": [o[2] for o in out], "size": [o[3] for o in out], "elements": [o[4].view(np.int64) for o in out],
                    "weights": [o[5].astype(np.int64) for o in out], "tokens": [o[6].view(np.int64) for o in out], "rest": [o[7].view(np.int64) for o in out],
                }
            )

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "role")
    return dealt.mapInPandas(tell, DIFFERENCES)


class _Block:
    """Texts that are held while others pass, each as elements with weights that differ from one and the same hub."""

    def __init__(self, held: list[tuple]):
        self.keys = [key for key, *_ in held]
        self.labels = np.array([label.hex() for _, label, *_ in held])
        self.sizes = np.array([size for *_, size, _, _ in held], np.int64)
        elements, weights = (np.concatenate([row[k] for row in held]) for k in (3, 4))
        owner = np.repeat(np.arange(len(held)), [len(row[3]) for row in held])
        order = np.argsort(elements, kind="stable")
        self.elements, self.weights, self.owner = elements[order], weights[order], owner[order]
        self.total = np.bincount(owner, weights=weights, minlength=len(held))

    def similarities(self, size: int, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.elements, elements), np.searchsorted(self.elements, elements, "right")
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], weights=np.minimum(self.weights[at], np.repeat(weights, n)), minlength=len(self.keys))
        common = (self.sizes + size - (self.total + weights.sum() - 2 * shared)) / 2
        return common / (self.sizes + size - common)


def _settled(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts of unlike labels, of those that pass and those that the blocks hold.

    ``rows`` has grp, role (0: held, 1: passing), key, label, size, elements
    and weights. Rows of a group lie together, those held first.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        block, group = None, None
        for batch in batches:
            out = []
            for grp, role, *row in batch[["grp", "role", "key", "label", "size", "elements", "weights"]].itertuples(index=False):
                if grp != group:
                    group, held, block = grp, [], None
                if role == 0:
                    held.append(row)
                    continue
                if not held:  # a block that no held one fell into
                    continue
                if block is None:
                    block = _Block(held)
                key, label, size, elements, weights = row
                unlike = block.labels != label.hex()
                if unlike.any():
                    near = unlike & (block.similarities(size, elements, weights) >= similarity)
                    out += [(block.keys[i], key) for i in np.flatnonzero(near)]
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "role")
    return dealt.mapInPandas(compare, "a binary, b binary").distinct()


def components(nodes: DataFrame, edges: DataFrame, home: str) -> DataFrame:
    """(key, label): the smallest key that each of ``nodes`` (key) is linked to by ``edges`` (a, b), in however many steps.

    Each round a node takes the smallest label around it, and then that
    label's label, so chains shorten by half; every round is written, and the
    rounds end when nothing changes.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), f"{home}/edges")
    touched = both.select(F.col("a").alias("key")).distinct()
    labels, n = stored(touched.withColumn("label", F.col("key")), f"{home}/labels0"), 0
    while True:
        old = labels.select(F.col("key").alias("k"), F.col("label").alias("l"))
        around = both.join(old, F.col("b") == F.col("k")).groupBy(F.col("a").alias("key")).agg(F.min("l").alias("near"))
        near = labels.join(around, "key").select("key", "label", F.least("label", "near").alias("near"))
        near = stored(near, f"{home}/near{n + 1}")
        up = near.select(F.col("key").alias("k"), F.col("near").alias("up"))
        new = near.join(up, F.col("near") == F.col("k"), "left").select("key", F.least("near", "up").alias("label"), (F.least("near", "up") != F.col("label")).alias("moved"))
        new = stored(new, f"{home}/labels{n + 1}")
        moved = new.where("moved").limit(1).count()
        labels, n = new.drop("moved"), n + 1
        if not moved:
            break
    rest = nodes.select("key").join(labels.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    return rest.select("key", F.coalesce("label", "key").alias("label"))


def _merged(labels: DataFrame, links: DataFrame, home: str) -> DataFrame:
    """Labels (key, label) after links (a, b) between keys have joined what these belong to."""
    a = labels.select(F.col("key").alias("ka"), F.col("label").alias("la"))
    b = labels.select(F.col("key").alias("kb"), F.col("label").alias("lb"))
    between = links.join(a, F.col("a") == F.col("ka")).join(b, F.col("b") == F.col("kb")).where("la <> lb")
    between = stored(between.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"{home}/between")
    if not between.limit(1).count():
        return labels
    over = components(labels.select(F.col("label").alias("key")).distinct(), between, f"{home}/over").withColumnRenamed("label", "top")
    return stored(labels.join(over.withColumnRenamed("key", "l"), F.col("label") == F.col("l")).select("key", F.col("top").alias("label")), f"{home}/labels")


class _Search:
    """The search for links among texts by key; ``queries`` and ``stream`` bound the blocks."""

    def __init__(self, texts: DataFrame, similarity: float, queries: int, stream: int):
        self.texts, self.similarity, self.queries, self.stream = texts, similarity, queries, stream

    def _with_hubs(self, spread: DataFrame, label: Column) -> DataFrame:
        group = F.xxhash64("hub", "part").alias("grp")
        heads = spread.select("hub", "part").distinct().select(group, F.lit(0).alias("role"), F.col("hub").alias("key"), F.lit(b"").alias("label"))
        rows = heads.unionByName(spread.select(group, F.lit(1).alias("role"), "key", label.alias("label")))
        return rows.join(self.texts, F.col("key") == F.col("text_key")).drop("text_key")

    def labels(self, members: DataFrame, home: str) -> DataFrame:
        """(key, label) of texts that share a bucket: ``members`` has bucket, key and n, the bucket's size."""
        queries, similarity = self.queries, self.similarity
        nodes = stored(members.groupBy("key").agg(F.sum("n").alias("degree")), f"{home}/nodes")
        ranked = members.join(nodes.withColumnRenamed("key", "node"), F.col("key") == F.col("node")).select("bucket", "key", "degree")
        best = F.max(F.struct("degree", "key"))["key"]
        hubs = stored(ranked.groupBy(F.col("bucket").alias("of")).agg(best.alias("hub")), f"{home}/hubs")
        pairs = members.join(hubs, F.col("bucket") == F.col("of")).where(F.col("hub") != F.col("key"))
        pairs = stored(pairs.select("hub", "key").distinct(), f"{home}/pairs")
        # a hub is sent to each part of its members; the more members, the more parts
        many = pairs.groupBy(F.col("hub").alias("of")).agg((F.count(F.lit(1)) / PART).cast("long").alias("more"))
        many = stored(many.where("more > 0"), f"{home}/many")
        spread = pairs.join(many, F.col("hub") == F.col("of"), "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("more", F.lit(0)) + 1))
        first = stored(_links(self._with_hubs(spread, F.lit(b"")), similarity), f"{home}/first")
        labels = stored(components(nodes, first, f"{home}/c1"), f"{home}/labels")

        # what is left: hubs of one class are as one, and their members of unlike labels meet under a token
        known = labels.select(F.col("key").alias("k"), "label")
        of_class = pairs.groupBy(F.col("hub").alias("key")).agg(F.count(F.lit(1)).alias("n")).join(known, F.col("key") == F.col("k"))
        of_class = stored(of_class.select("key", "n", "label"), f"{home}/hub_classes")
        heads = of_class.groupBy(F.col("label").alias("l")).agg(F.max(F.struct("n", "key")).alias("most"))
        heads = stored(of_class.join(heads, F.col("label") == F.col("l")).select(F.col("key").alias("of"), F.col("most.key").alias("head"), F.col("label").alias("own")), f"{home}/heads")
        left = pairs.join(heads, F.col("hub") == F.col("of")).where(F.col("head") != F.col("key")).select(F.col("head").alias("hub"), "own", "key").distinct()
        left = stored(left.join(known, F.col("key") == F.col("k")).select("hub", "own", "key", "label"), f"{home}/left")
        unlike = left.groupBy(F.col("hub").alias("of")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
        unlike = stored(unlike.where("a <> b").select("of", (F.col("n") / PART).cast("long").alias("more")), f"{home}/unlike")
        left = left.join(unlike, F.col("hub") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("more") + 1))
        apart = stored(_differences(self._with_hubs(left, F.col("label")), similarity), f"{home}/apart")
        # one that is close to the head after all, though not of its class
        close = apart.where("kind = 0 AND NOT outside").join(left.select(F.col("hub").alias("h"), F.col("key").alias("k"), "own"), (F.col("hub") == F.col("h")) & (F.col("key") == F.col("k")))
        close = close.where("own <> label").select(F.col("hub").alias("a"), F.col("key").alias("b"))
        # hubs whose members fit a block are settled whole, each member once
        fits = (F.count(F.lit(1)) <= queries) & (F.sum(F.size("elements")) <= HELD)
        groups = apart.groupBy(F.col("hub").alias("h"), F.col("kind").alias("d")).agg(_unlike(), _n_of(F.col("outside")).alias("passing"), fits.alias("fits"))
        groups = stored(groups.where("unlike AND passing > 0").select("h", "d", "fits"), f"{home}/groups")
        here = (F.col("hub") == F.col("h")) & (F.col("kind") == F.col("d"))
        small = apart.join(groups.where("fits"), here).withColumn("role", F.explode(F.when(F.col("outside"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        small = small.select(F.xxhash64("hub", "kind").alias("grp"), *_PAYLOAD)
        labels = _merged(labels, stored(_settled(small, similarity).unionByName(close).distinct(), f"{home}/more"), f"{home}/m2")
        if not groups.where("NOT fits").limit(1).count():
            return labels

        # in all others members meet under tokens
        known = labels.select(F.col("key").alias("k"), "label")
        large = apart.join(groups.where("NOT fits"), here).drop("label").join(known, F.col("key") == F.col("k"))
        large = large.select("hub", "kind", "key", "label", "outside", F.size("elements").alias("n"), "tokens", "rest")
        owned = lambda tokens, own: large.select("hub", "kind", "key", "label", "outside", "n", F.lit(own).alias("own"), F.explode(tokens).alias("token"))
        group = F.xxhash64("hub", "kind", "token").alias("group")
        met = owned("tokens", True).unionByName(owned("rest", False)).select(group, "hub", "kind", "key", "label", "outside", "own", "n")
        blocks = F.greatest(_n_of(F.col("own")) / queries, F.sum(F.when(F.col("own"), F.col("n"))) / HELD).cast("long") + 1
        parts = (_n_of(F.col("outside")) / self.stream).cast("long") + 1
        counts = met.groupBy(F.col("group").alias("of")).agg(_unlike(), _n_of(F.col("own")).alias("held"), _n_of(F.col("outside")).alias("passing"), blocks.alias("blocks"), parts.alias("parts"))
        counts = stored(counts.where("unlike AND held > 0 AND passing > 0").select("of", "blocks", "parts"), f"{home}/counts")
        met = stored(met.join(counts, F.col("group") == F.col("of")).drop("of", "label", "n"), f"{home}/met")
        if not met.limit(1).count():
            return labels
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        held = met.where("own").select("*", F.lit(0).alias("role"), F.pmod(F.xxhash64("key", F.lit(1)), "blocks").alias("block"), every("parts").alias("part"))
        passing = met.where("outside").select("*", F.lit(1).alias("role"), every("blocks").alias("block"), F.pmod(F.xxhash64("key", F.lit(2)), "parts").alias("part"))
        rows = held.unionByName(passing).select(F.xxhash64("group", "block", "part").alias("grp"), "role", F.col("hub").alias("h"), F.col("kind").alias("d"), F.col("key").alias("k"))
        rows = rows.join(apart, here & (F.col("key") == F.col("k"))).select("grp", *_PAYLOAD)
        return _merged(labels, stored(_settled(rows, similarity), f"{home}/blocks"), f"{home}/m3")


def _n_of(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0))


def _unlike() -> Column:
    return (F.min("label") < F.max("label")).alias("unlike")


def classes(docs: DataFrame, similarity: float = SIMILARITY, queries: int = QUERIES, stream: int = STREAM) -> DataFrame:
    """(key, label) of each distinct text that another text is linked to; all others are classes of their own.

    ``docs`` has ``__key`` and text. All is written here, in small batches; the session's own setting stays.
    """
    with batches_of(docs.sparkSession):
        return _classes(docs, similarity, queries, stream)


def _classes(docs: DataFrame, similarity: float, queries: int, stream: int) -> DataFrame:
    home = shared_dir(docs.sparkSession)
    signed = stored(_signed(docs), f"{home}/signed")
    bucketed = signed.select("key", F.explode("bands").alias("bucket")).distinct()
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stored(sizes, f"{home}/sizes").withColumnRenamed("bucket", "of")
    members = signed.select("key", F.explode("bands").alias("bucket")).join(sizes, F.col("bucket") == F.col("of")).drop("of").distinct()
    members = stored(members.select("bucket", "key", "n"), f"{home}/members")
    texts = docs.select(F.col("__key").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    # one plan at every size: the members' keys grow with the corpus and are not sent to all tasks
    texts = texts.join(members.select("key").distinct().hint("merge"), F.col("text_key") == F.col("key"), "left_semi")
    # written before copies are put together: so the join may split a text of very many copies
    texts = stored(texts, f"{home}/found")
    texts = stored(texts.groupBy("text_key").agg(F.first("text").alias("text")), f"{home}/texts")

    labels = _Search(texts, similarity, queries, stream).labels(members, home)
    return stored(labels, f"{home}/classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **blocks) -> DataFrame:
    """(doc_id, class_id, n_texts, n_docs), one row for each row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class, ``n_texts`` how many
    different texts it has and ``n_docs`` how many rows. Texts of fewer than
    five words are one shingle of all their words; null, empty and wordless
    texts are linked to equal texts only (null counts as empty). Repeated rows
    are rows of one class. Null ids have no part in ``class_id``; a class of
    null ids alone has a null one. Other columns are not read.
    """
    keyed = with_key(docs.select("doc_id", "text"))
    home = shared_dir(docs.sparkSession)
    found = classes(keyed, similarity, **blocks).withColumnRenamed("key", "k")
    rows = stored(keyed.select("doc_id", "__key"), f"{home}/rows")
    texts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    texts = texts.join(found, F.col("__key") == F.col("k"), "left").select("__key", "n", "least", F.coalesce("label", "__key").alias("label"))
    texts = stored(texts, f"{home}/texts")
    sums = texts.groupBy("label").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_docs"))
    sums = texts.select("__key", "label").join(sums, "label").select(F.col("__key").alias("k"), "class_id", "n_texts", "n_docs")
    sums = stored(sums, f"{home}/sums")
    return rows.join(sums, F.col("__key") == F.col("k")).select("doc_id", "class_id", "n_texts", "n_docs")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest doc_id, nulls last.

    All columns are kept, whatever their names. Rows that tie in doc_id and
    text are one row's copies, and any of them stays.
    """
    home = shared_dir(docs.sparkSession)
    key, an_id, pick = spare(docs, "key", "id", "pick")
    keyed = with_key(docs, key)
    found = classes(keyed.select("text", F.col(key).alias("__key")), similarity).select(F.col("key").alias("k"), F.col("label").alias("l"))
    rows = keyed.select("doc_id", F.col(key).alias("__key")).join(found, F.col("__key") == F.col("k"), "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__key").alias("key"))).alias("p")
    picks = rows.groupBy(F.coalesce("l", "__key")).agg(least).select(F.col("p.doc_id").alias(an_id), F.col("p.key").alias(pick))
    picks = stored(picks, f"{home}/picks")
    kept = keyed.join(picks, F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(key) == F.col(pick)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)
