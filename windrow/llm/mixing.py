"""Mix sources to target weights by repeating documents. DataFrame functions only.

Sources share all words by weight. A target stops at ``max_repeats`` times its source, and what is over
goes to the others by weight, until none is above. A document is emitted floor(rate) times, rate being
target / size of its source, and once more if a number hashed from the seed and its doc_id is below the fraction.

Documents without text have size 0. A null source is a source of its own, after the others. Documents with
a null or repeated doc_id draw like any other (equal ids draw alike). A source without words has target 0 and
its documents are emitted once: they take no words. There is one row per source in the plan of targets, and
a running sum over them: made for thousands of sources, not for one per document.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import WORD, small, text_of
from windrow.storage import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def draw(seed: str) -> Column:
    """A number in [0, 1) from the seed and doc_id: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    With the sources in order of their cap per weight, those up to some place get their cap, and the rest
    share what remains by weight. The place is the first at which the next cap is not reached.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    caps = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = caps.withColumn("level", left / F.sum("weight").over(onwards))
    level = level.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level at the first open place holds for all after it
    share = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(
        all_rows
    )
    target = F.least(F.col("cap"), F.coalesce(share["level"] * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    return level.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix has the document).

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    sizes = materialize(docs.select("source", word_count().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    return _copies(docs.withColumn("size", word_count()), source_targets(sizes, weights, max_repeats), seed)


def _copies(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    targets = materialize(targets, "mix-targets")
    plan = small(targets.withColumnsRenamed({"source": "of_source"}).drop("weight"), targets.count())
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    whole = F.floor("rate")
    copies = whole + F.when(draw(seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("rate")


def mix_plan(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. The text is read once."""
    sizes = materialize(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    planned = _copies(sizes, source_targets(sizes, weights, max_repeats), seed)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    rows = with_copies(docs.select(F.struct(*names).alias("row"), "text", "source", "doc_id"), seed, weights, max_repeats)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.filter("copies > 0").select("row", times).select("row.*")
