"""Exact dedup: two passes with a Bloom filter, then groups only of what may repeat. DataFrame functions only.

Texts are equal when they are identical after every run of blanks (space, \\t \\n \\v \\f \\r) is replaced
by one space; null counts as empty. Of equal texts the row with the smallest doc_id stays.

The first pass counts, for two positions per text hash, how many rows hit each position of a bit field,
and keeps a bit where two or more did. The second pass tests every row: one whose two bits are not both
set has no equal and passes straight through; the others are shuffled by their SHA-256 and decided
exactly. A filter that is too small for the table only sends more rows through the exact way.

Null doc_ids order last. Rows that repeat both text and doc_id count one by one, and one of them stays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import BLANKS, HOT_SHARE, attach, text_of
from windrow.storage import materialize

#: Bits of the filter for each row, as long as the field has fewer than MAX_BITS.
BITS_PER_ROW = 16
#: The bit field is broadcast, so this bounds the broadcast: 2^28 bits are 32 MB.
MAX_BITS = 1 << 28
_MIN_BITS = 1 << 16
#: A page of the bit field is one broadcast row of 64 words of 64 bits.
_PAGE_BITS = 4096


def normalized(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), BLANKS, " ")


def _field_bits(rows: int, max_bits: int) -> int:
    return min(max_bits, max(_MIN_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length()))


def _positions(h: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 34).bitwiseAND(mask)]


def repeat_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """Pages of the bit field: ``page``, ``words``. A bit is set where two or more rows of ``h`` hit."""
    hit = hashes.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("slot"))
    twice = hit.groupBy("slot").agg(F.count("*").alias("c")).filter("c > 1")
    words = twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")
    )
    entries = words.groupBy(F.shiftright("word", 6).alias("page")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)).alias("k"), "bits"))).alias("m")
    )
    return entries.select(
        "page", F.expr("transform(sequence(0L, 63L), k -> coalesce(try_element_at(m, k), 0L))").alias("words")
    )


def mark_possible(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``possible``: false if no other row has the hash ``h``. Nothing is shuffled."""
    pages = F.broadcast(pages)
    tested = F.lit(True)
    for i, at in enumerate(_positions(F.col("h"), bits)):
        side = pages.select(F.col("page").alias(f"page{i}"), F.col("words").alias(f"words{i}"))
        rows = rows.withColumn(f"at{i}", at)
        rows = rows.join(side, F.shiftright(f"at{i}", 12) == F.col(f"page{i}"), "left")
        bit = F.expr(
            f"shiftrightunsigned(element_at(words{i}, cast(shiftright(at{i}, 6) & 63 AS int) + 1), cast(at{i} & 63 AS int)) & 1"
        )
        tested = tested & F.coalesce(bit == 1, F.lit(False))
    extra = [f"{c}{i}" for i in range(2) for c in ("at", "page", "words")]
    return rows.withColumn("possible", tested).drop(*extra)


def _slim(docs: DataFrame) -> DataFrame:
    text = normalized()
    hashed = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    return hashed.withColumn("h", F.xxhash64("text_sha256"))


def _first_pass(docs: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The hashes, the bit field, its size and the number of rows."""
    slim = materialize(_slim(docs), "dedup-hashes")
    rows = slim.count()
    bits = _field_bits(max(rows, 1), max_bits)
    return slim, materialize(repeat_filter(slim, bits), "dedup-filter"), bits, rows


def _groups(possible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per (text, doc_id), and one row per text.

    The latter has keep_id, group_size, n_rows (members) and keep_copies (rows that repeat the one that stays).
    """
    members = materialize(
        possible.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "dedup-members"
    )
    groups = members.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"),
        F.sum("copies").alias("group_size"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.min_by("copies", "doc_id"), F.sum("copies")).alias("keep_copies"),
    )
    return members, materialize(groups, "dedup-groups")


def dedup_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    slim, pages, bits, rows = _first_pass(docs, max_bits)
    marked = mark_possible(slim, pages, bits)
    single = marked.filter(~F.col("possible")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    members, groups = _groups(marked.filter("possible"))
    joined = attach(members, groups, ["text_sha256"], rows, "inner")
    # rows that are equal in text and doc_id: the first of them may stay
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    decided = copies.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(decided)


def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a text that has no equal is not shuffled.

    Of rows that repeat text and doc_id but differ in other columns, the first by these columns as JSON stays.
    Copies of a hot text (see ``attach``) are not shuffled either: the few texts that are hot are broadcast.
    """
    slim, pages, bits, rows = _first_pass(docs, max_bits)
    _, groups = _groups(mark_possible(slim, pages, bits).filter("possible"))
    groups = groups.filter("group_size > 1")
    is_hot = F.col("group_size") > rows * HOT_SHARE
    hot = F.broadcast(groups.filter(is_hot))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(normalized().cast("binary"), 256).alias("text_sha256"))
    tested = mark_possible(whole.withColumn("h", F.xxhash64("text_sha256")), pages, bits)
    stays = F.col("group_size").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id"))
    here = tested.join(hot, "text_sha256", "left").filter(~F.col("possible") | F.col("group_size").isNotNull())
    shuffled = (
        tested.filter("possible")
        .join(hot.select("text_sha256"), "text_sha256", "left_anti")
        .join(groups.filter(~is_hot), "text_sha256", "left")
    )
    kept = here.filter(stays).unionByName(shuffled.filter(stays))
    if groups.filter("keep_copies > 1").isEmpty():
        return kept.select("row.*")
    several = F.coalesce(F.col("keep_copies") > 1, F.lit(False))
    first = kept.filter(several).groupBy("text_sha256").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter(~several).select("row.*").unionByName(first.select("row.*"))
