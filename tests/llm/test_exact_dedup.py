import hashlib
import re
from collections import Counter, defaultdict

import pytest

from windrow.llm import exact_dedup
from windrow.llm.exact_dedup import dedup_groups, drop_copies

from .conftest import DOCS, edge_rows


def brute(rows):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r[1])].append(r[0])
    out = Counter()
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            out[i, keep, len(ids), i == keep and not seen, h] += 1
            seen |= i == keep
    return out


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 64])
def test_groups_against_brute_force(edge_docs, max_bits):
    """Also with a filter so small that every row goes the exact way."""
    got = Counter(tuple(r) for r in dedup_groups(edge_docs, max_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute(edge_rows())


@pytest.mark.parametrize("hot", [1 / 256, 0.01, 1.0])
def test_rows_that_stay(spark, clashing_docs, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot)
    stay = drop_copies(clashing_docs)
    assert stay.columns == clashing_docs.columns
    want = Counter((i, h) for (i, k, n, kept, h), c in brute(edge_rows()).items() if kept for _ in range(c))
    got = Counter((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in stay.collect())
    assert got == want


def test_ties_in_id_and_text_keep_the_first_by_the_other_columns(spark):
    docs = spark.createDataFrame([(1, "t", "en", "b", 1), (1, "t", "de", "a", 2), (2, "u", "x", "y", 3)], DOCS)
    assert sorted((r.doc_id, r.lang) for r in drop_copies(docs).collect()) == [(1, "de"), (2, "x")]


def test_empty(no_docs):
    assert dedup_groups(no_docs).count() == 0
    assert drop_copies(no_docs).count() == 0


def test_texts_without_equal_are_not_shuffled(spark, sf_dir):
    """The filter of the second pass finds (nearly) all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim, pages, bits, rows = exact_dedup._first_pass(docs, exact_dedup.MAX_BITS)
    possible = exact_dedup.mark_possible(slim, pages, bits).filter("possible")
    repeated = dedup_groups(docs).filter("group_size > 1").count()
    assert repeated <= possible.count() <= repeated + 0.05 * rows
