"""MinHash near-dedup with circulant permutations: links between documents, and the groups they make.

Two permutations make a whole signature: the first scatters the shingles over a circle of 2^32 places, the second
orders the places, and coordinate i is the least under the second after turning the circle by i. Bands of ``ROWS`` coordinates
make candidate buckets; a link at similarity 0.8 shares no bucket with a chance of 5 in a million, one at 0.9 of 10^-13.

Documents of equal shingle sets are one class from the start. The classes of a bucket are not compared in pairs. Each is compared
with a hub, the class that shares most bucket places with others: among the copies of one text this is the text itself. That
links what is near the hub. For the rest, let C be the hub's set, and let each class be told by what it lacks of C and what
it adds to C. Two classes of which one is not linked to the hub can only be linked if

* they share an added shingle; and then one of the least 20 % of each set, in the order of the hashes, among what they add, because
  the other set must hold 80 % of each; or
* one is smaller than C, and its size and what both lack leave room for the link: |x| + |y| <= 9/4 (|C| - what either lacks).

So only classes that add the same shingle meet again: few of them are paired, and of more the signatures are compared, block by
block in the tasks, which hand on likely pairs only. As long as they are in one component nothing is compared at all. Copies that
differ from a text in places of their own share nothing but the text, so a bucket of thousands of them costs a few comparisons
each, linked or not. What stays quadratic is the comparison of signatures among copies of a text that is not there itself.

A pair is sorted out by the sizes of the sets and by the signature, at 4.5 standard errors below the threshold, before
texts are read. Links are confirmed on the full sets.

Rows without words, or without a doc_id, are linked with nothing; the former have n_shingles 0, the latter component_id
null, and both are kept. Rows that share a doc_id are one document: linked, and kept or dropped together.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import attach, small, text_of
from windrow.llm.shingles import by_bytes, mix64, shingle_sets
from windrow.storage import intermediates, materialize

#: Words in a shingle where nothing else is asked for, and percent of similarity.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 40, 6
#: Coordinates of a signature; the first ones make the bands, the low bytes of all tell pairs that can't be links.
COORDINATES = 384
#: Standard errors below the threshold where a link lies three times in a million.
_SLACK = 4.5
#: Up to so many classes that add the same shingle are paired, more are compared in blocks.
FEW = 8
BLOCK = 256
#: Texts, and shingles in them, compared with one hub in one task.
CHUNK, CHUNK_SHINGLES = 256, 200_000

U32 = np.uint32
_SCATTER = np.uint64(0x5851F42D4C957F2D)
_ORDER = U32(0x9E3779B9)


def _order(places: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit places."""
    x = places ^ _ORDER
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row of coordinates for each."""
    places = (mix64(np.concatenate(sets) ^ _SCATTER) >> np.uint64(32)).astype(U32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), coordinates), U32)
    for i in range(coordinates):
        out[:, i] = np.minimum.reduceat(_order(places - U32(i)), starts)
    return out


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that tell sets apart."""
    halves = [np.array([mix64(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64) for c in (0x1F83D9AB, 0x5BE0CD19)]
    return [a.tobytes() + b.tobytes() for a, b in zip(*halves)]


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, cls (the set), bands, bytes (low byte of each coordinate), of every row. No shuffle."""

    def sketch(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                doc_ids = batch.column(0).slice(start, 512)
                texts = [t.as_buffer().to_pybytes() for t in batch.column(1).slice(start, 512).cast(pa.binary())]
                rows = []
                for i, j in by_bytes(texts):
                    sets = shingle_sets(texts[i:j], words)
                    full = [s for s in sets if len(s)]
                    if full:
                        signed = signatures(full)
                        bands = signed[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS).astype(np.uint64)
                        key = np.zeros((len(full), BANDS), np.uint64)
                        for r in range(ROWS):
                            key = mix64(key * np.uint64(31) + bands[:, :, r])
                        key = mix64(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                        found = iter(zip(set_keys(full), key, (signed & U32(255)).astype(np.uint8)))
                    for s in sets:
                        cls, band, low = next(found) if len(s) else (None, None, None)
                        rows.append((len(s), cls, band, low.tobytes() if len(s) else None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.binary())],
                    ["doc_id", "n_shingles", "cls", "bands", "low"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, cls binary, bands array<long>, low binary")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    p = percent / 100
    least = p - _SLACK * (p * (1 - p) / COORDINATES) ** 0.5

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), COORDINATES) for s in (x, y))
        return pd.Series((a == b).mean(axis=1))

    for side in "ab":
        own = classes.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("low").alias(f"low_{side}"))
        pairs = pairs.join(own, side)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.filter(sizes).filter(alike("low_a", "low_b") >= least).select("a", "b")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links, by the full sets of their texts. ``a`` is the side that many pairs may share."""
    with intermediates(docs.sparkSession) as scope:
        found = _compared(pairs, classes, docs, words, percent, False)
        return scope.keep(found.filter("linked").select("a", "b"), "near-links")


_COMPARED = "a binary, b binary, linked boolean, n_a long, n_b long, lacks long, adds array<long>"


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, with_rest: bool) -> DataFrame:
    """Each pair, whether it is a link, how much of ``a`` is not in ``b``, and (``with_rest``) the least of what ``b`` adds."""
    sizes = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("size"))
    pairs = materialize(pairs.join(sizes, "b"), "near-pairs")
    per_hub = pairs.groupBy("a").agg(F.count("*").alias("n_rows"), F.sum("size").alias("size"))
    chunks = F.ceil(F.greatest(F.col("n_rows") / CHUNK, F.col("size") / CHUNK_SHINGLES)).cast("int")
    chunks = materialize(per_hub.select("a", chunks.alias("chunks")), "near-chunks")
    wide = chunks.filter("chunks > 1")
    dealt = (
        pairs.drop("size").join(small(wide, wide.count()), "a", "left")
        .withColumn("chunk", F.pmod(F.hash("b"), F.coalesce("chunks", F.lit(1))))
        .drop("chunks")
    )
    hubs = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    wanted = dealt.select("a", "chunk", F.col("b").alias("cls")).unionByName(hubs.select("a", "chunk", F.col("a").alias("cls")))
    wanted = materialize(wanted.join(classes.select("cls", "doc_id"), "cls"), "near-wanted")
    ids = materialize(wanted.select("doc_id").distinct(), "near-ids")
    texts = docs.select("doc_id", text_of().alias("text")).join(small(ids, ids.count()), "doc_id", "left_semi")
    texts = materialize(texts, "near-texts")
    rows = wanted.join(texts, "doc_id").drop("doc_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a = group["a"].iloc[0]
        own = [t.encode() for t in group["text"]]
        sets: dict[bytes, np.ndarray] = {}
        for i, j in by_bytes(own):
            found = shingle_sets(own[i:j], words)
            # of rows that share a doc_id only the one with the wanted set counts
            filled = [(c, s) for c, s in zip(group["cls"][i:j], found) if len(s)]
            sets |= {bytes(c): s for (c, s), key in zip(filled, set_keys([s for _, s in filled])) if bytes(c) == key}
        hub = sets.pop(bytes(a))
        out = []
        for c, s in sets.items():
            at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
            new = hub[at] != s
            both = len(s) - int(new.sum())
            linked = 100 * both >= percent * (len(hub) + len(s) - both)
            # the sets are sorted by hash, so these are the least
            adds = s[new][: len(s) * (100 - percent) // 100 + 1].view(np.int64) if with_rest else []
            out.append((bytes(a), c, linked, len(hub), len(s), len(hub) - both, adds))
        return pd.DataFrame(out, columns=["a", "b", "linked", "n_a", "n_b", "lacks", "adds"]).astype({"a": object, "b": object, "adds": object})

    return rows.groupBy("a", "chunk").applyInPandas(compare, _COMPARED)


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node can reach: node, label. Least labels spread until none changes."""
    with intermediates(links.sparkSession) as scope:
        turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = materialize(links.select("a", "b").unionByName(turned).distinct(), "near-edges")
        first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
        labels = materialize(first, "near-labels")
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b")
            near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
            lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
            # and jump: the label of one's label
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            lower = lower.join(jump, "label", "left").withColumn("label", F.least("label", F.coalesce("next", "label")))
            step = materialize(lower.select("node", "old", "label"), "near-labels")
            labels = step.select("node", "label")
            if step.filter("label <> old").isEmpty():
                return scope.keep(labels, "near-components")


def _labelled(rows: DataFrame, links: DataFrame, cls: str = "cls") -> DataFrame:
    """Rows with the component of their class."""
    labels = components(links).withColumnRenamed("node", cls)
    return rows.join(small(labels, labels.count()), cls, "left").withColumn("label", F.coalesce("label", cls))


def _apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Labelled rows of the buckets that hold more than one component, with the number of rows of each."""
    rows = materialize(_labelled(rows, links), "near-labelled")
    bounds = rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = materialize(bounds.filter("low <> high").select("bucket", "n_rows"), "near-apart")
    return materialize(attach(rows, apart, ["bucket"], max(rows.count(), 1), "inner"), "near-rows")


def _with_hubs(rows: DataFrame) -> DataFrame:
    """Rows of buckets with the hub of each, ``a``: the class with the most places in all buckets together."""
    known = materialize(rows.groupBy("cls").agg(F.sum("n_rows").alias("places")), "near-places")
    ranked = rows.join(small(known, known.count()), "cls")
    hub = F.max_by("cls", F.struct("places", F.xxhash64("cls"), "cls"))
    hubs = ranked.groupBy("bucket").agg(hub.alias("a"), F.first("n_rows").alias("n_rows"))
    hubs = materialize(hubs, "near-hubs")
    total = hubs.agg(F.sum("n_rows")).first()[0] or 1
    return materialize(attach(rows.drop("n_rows", "label"), hubs, ["bucket"], total, "inner"), "near-hub-rows")


def _meetings(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What may still be linked among the classes compared with one hub: pairs (a, b), and the classes that are too many for pairs.

    ``members`` is a written table of the comparisons, with the label of each class.
    """
    add = members.select("a", "b", "label", "linked", "n_b", F.explode("adds").alias("shingle"))
    code = F.xxhash64("b")
    sets = add.groupBy("a", "shingle").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(code, 8)).alias("s1"), F.bit_xor(code).alias("s2"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.bool_and("linked").alias("all_linked"),
    )
    # of shingles that the same classes add one is enough
    sets = sets.filter("n > 1 AND low <> high AND NOT all_linked").groupBy("a", "n", "s1", "s2").agg(F.min("shingle").alias("shingle"))
    sets = materialize(sets.select("a", "shingle", "n"), "near-sets")
    met = materialize(add.join(small(sets, sets.count()), ["a", "shingle"]), "near-met")
    few = met.filter(F.col("n") <= FEW).select("a", "shingle", "b", "label", "linked", "n_b")
    other = few.select("a", "shingle", *[F.col(c).alias(f"{c}_2") for c in ("b", "label", "linked", "n_b")])
    fits = F.least("n_b", "n_b_2") * 100 >= F.greatest("n_b", "n_b_2") * percent
    apart = (F.col("label") != F.col("label_2")) & ~(F.col("linked") & F.col("linked_2")) & fits
    pairs = few.join(other, ["a", "shingle"]).filter("b < b_2").filter(apart).select(F.col("b").alias("a"), F.col("b_2").alias("b"))

    # one lacks so much that a smaller one may be nearer to it than the hub
    room = F.expr(f"({100 + percent} * (n_a - lacks)) div {percent} - n_b")
    least = F.ceil(F.col("n_b") * percent / 100).cast("long")
    far = members.filter("NOT linked").withColumn("room", room).filter(F.col("room") >= least)
    far = far.select("a", F.col("b").alias("b_2"), F.col("label").alias("label_2"), F.col("n_b").alias("n_b_2"), F.explode(F.sequence(least, F.least("room", "n_a"))).alias("n_b"))
    near = members.select("a", "b", "label", "n_a", "n_b", "lacks").filter("n_b < n_a")
    fits = F.expr(f"{100 + percent} * (n_a - lacks) >= {percent} * (n_b + n_b_2)")
    smaller = far.join(near, ["a", "n_b"]).filter(fits & (F.col("label") != F.col("label_2")) & (F.col("b") != F.col("b_2")))
    pairs = pairs.unionByName(smaller.select(F.least("b", "b_2").alias("a"), F.greatest("b", "b_2").alias("b")))
    return pairs.distinct(), met.filter(F.col("n") > FEW).select("a", "b", "label", "linked").distinct()


def _in_blocks(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) among the classes that share a hub, in different components, from their signatures."""
    sized = classes.select(F.col("cls").alias("b"), "n_shingles", "low")
    rest = materialize(rest.join(sized, "b"), "near-rest")
    groups = materialize(rest.groupBy("a").agg(F.count("*").alias("n_rows")), "near-rest-groups")
    rows = attach(rest, groups, ["a"], max(rest.count(), 1), "inner")
    blocks = F.ceil(F.col("n_rows") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("b"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # a block meets every block of its group once: the pair of blocks is what a task gets
    met = rows.select("a", "block", other, "b", "label", "linked", "n_shingles", "low").select(
        "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "b", "label", "linked", "n_shingles", "low"
    )
    p = percent / 100
    least = p - _SLACK * (p * (1 - p) / COORDINATES) ** 0.5

    def likely(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        low = np.frombuffer(b"".join(group["low"]), np.uint8).reshape(len(group), COORDINATES)
        label = pd.factorize(group["label"].map(bytes))[0]
        linked, size = group["linked"].to_numpy(bool), group["n_shingles"].to_numpy()
        x, y = (np.flatnonzero(group["block"].to_numpy() == k) for k in (i, j))
        out = []
        for at, r in enumerate(x):
            other = y[at + 1 :] if i == j else y
            fits = (label[other] != label[r]) & ~(linked[other] & linked[r])
            fits &= 100 * np.minimum(size[other], size[r]) >= percent * np.maximum(size[other], size[r])
            other = other[fits]
            out += [(r, s) for s in other[(low[other] == low[r]).mean(axis=1) >= least]]
        names = [bytes(b) for b in group["b"]]
        pairs = [(min(names[r], names[s]), max(names[r], names[s])) for r, s in out]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=object)

    return met.groupBy("a", "i", "j").applyInPandas(likely, "a binary, b binary")


def _class_links(classes: DataFrame, buckets: DataFrame, docs: DataFrame, given: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between classes, enough to connect what is connected; ``given`` are links known before."""
    links, rows = given, buckets

    def compared(pairs: DataFrame) -> DataFrame:
        nonlocal links
        found = materialize(_compared(pairs, classes, docs, words, percent, True), "near-compared")
        links = materialize(links.unionByName(found.filter("linked").select("a", "b")), "near-links")
        return found

    rows = _apart(rows, links)
    if rows.isEmpty():
        return links
    # each class with the hub of its largest bucket, and with the others where that did not do
    rows = _with_hubs(rows)
    first = rows.filter("cls <> a").groupBy(F.col("cls").alias("b")).agg(F.max_by("a", F.struct("n_rows", "a")).alias("a"))
    near = compared(first.select("a", "b"))
    rows = _apart(rows.select("bucket", "cls", "a"), links)
    if rows.isEmpty():
        return links
    pairs = materialize(rows.filter("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "near-hub-pairs")
    others = compared(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"))
    members = _labelled(near.join(pairs, ["a", "b"], "left_semi").unionByName(others), links, "b")
    pairs, rest = _meetings(materialize(members, "near-members"), percent)
    pairs = _likely(materialize(pairs, "near-meetings"), classes, percent)
    pairs = pairs.unionByName(_in_blocks(rest, classes, percent)).distinct()
    return links.unionByName(_confirmed(pairs, classes, docs, words, percent))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    rows = materialize(sketches(docs, words), "near-sketches")
    linked = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # one class for each set; its least doc_id stands for it
    groups = materialize(linked.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows")), "near-groups")
    classes = linked.join(groups.select("cls", "doc_id"), ["cls", "doc_id"], "left_semi").dropDuplicates(["cls"])
    classes = materialize(classes, "near-classes")
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = materialize(shared, "near-shared")
    buckets = materialize(buckets.join(small(shared, shared.count()), "bucket", "left_semi"), "near-buckets")
    # sets of one doc_id belong together
    total = max(rows.count(), 1)
    ids = linked.select("doc_id", "cls").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a <> z")
    ids = materialize(ids.select("doc_id", "a"), "near-shared-ids")
    given = linked.join(small(ids, ids.count()), "doc_id").select("a", F.col("cls").alias("b")).filter("a <> b").distinct()
    links = _class_links(classes, buckets, docs, materialize(given, "near-given"), words, percent)
    labels = components(links).withColumnRenamed("node", "cls")
    named = groups.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_classes"))
    least = materialize(least, "near-least")
    named = materialize(attach(named, least, ["label"], total, "inner", "n_classes").select("cls", "component_id", "n_rows"), "near-named")
    found = attach(linked.select("doc_id", "n_shingles", "cls"), named, ["cls"], total, "inner").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group.

    A document without words stays, unless another row of its doc_id goes.
    """
    dropped = near_groups(docs, words, percent).filter(~F.col("kept")).select("doc_id").distinct()
    dropped = materialize(dropped, "near-dropped")
    return docs.join(small(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)
