import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from windrow.llm import near_dedup
from windrow.llm.near_dedup import drop_near_copies, near_groups
from windrow.llm.shingles import shingle_sets, word_hashes

from .conftest import DOCS, edge_rows, words


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    """All pairs. Rows that share a doc_id are linked."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            both = len(a & b)
            if rows[i][0] == rows[j][0] or 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    out = Counter()
    for i, r in enumerate(rows):
        c = r[0] if not sets[i] or r[0] is None else min(least[root(i)])
        out[r[0], len(sets[i]), c, r[0] == c] += 1
    return out


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def family_rows():
    """Two hot families that hang together by chains, a third at the threshold, and copies of everything."""
    rng = random.Random(3)
    rows, base = [], [words(rng, 120) for _ in range(6)]
    for f, b in enumerate(base):
        text = b
        for _ in range(60 if f < 2 else 12):
            text = edited(rng, text if rng.random() < 0.5 else b, rng.randint(0, 3))
            rows.append(text)
    rows += [r.upper() for r in rows[::7]]
    rng.shuffle(rows)
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("k", [4, 5])
def test_edge_rows(clashing_docs, k):
    assert result(near_groups(clashing_docs, words=k)) == brute(edge_rows(), k)


@pytest.mark.parametrize("few, chunk, block", [(8, 256, 256), (0, 3, 5), (1000, 4, 256)])
def test_families(spark, monkeypatch, few, chunk, block):
    """Pairs of what adds the same shingle, blocks of it, and both find the same groups."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = family_rows()
    assert result(near_groups(spark.createDataFrame(rows, DOCS).repartition(5), words=4)) == brute(rows, 4)


def star_rows(n, share):
    """A text and copies of it with words changed in places of their own."""
    rng = random.Random(n)
    base = words(rng, 160)
    return [(0, base, "en", "s", 0)] + [(i, edited(rng, base, rng.choice(share)), "en", "s", 0) for i in range(1, n)]


@pytest.mark.parametrize("n, share", [(200, [3, 4]), (300, [3, 4, 8, 9, 10])])
def test_star(spark, monkeypatch, n, share):
    """Copies near one text, most of them not near each other, cost a few comparisons each."""
    compared = []
    real = near_dedup._compared

    def counted(pairs, *rest):
        pairs = near_dedup.materialize(pairs, "counted")
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_compared", counted)
    rows = star_rows(n, share)
    assert result(near_groups(spark.createDataFrame(rows, DOCS), words=4)) == brute(rows, 4)
    assert sum(compared) <= 8 * n, compared


def truncated_rows():
    """Chains of texts that only lose words, where the link is by what both lack; and two that add the same."""
    rng = random.Random(11)
    base = words(rng, 200).split(" ")
    texts = [base, base[20:], base[20:] + words(rng, 26).split(" "), base[40:], base[60:], base[:170], base[:140], base[15:185]]
    more = words(rng, 60).split(" ")
    texts += [base + more, base + more[:55], base[30:] + more, base[5:] + words(rng, 60).split(" ")]
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


def test_truncated(spark):
    rows = truncated_rows()
    assert result(near_groups(spark.createDataFrame(rows, DOCS), words=4)) == brute(rows, 4)


def test_what_a_hub_rules_out():
    """The two ways to be linked past a hub are all there are: sets of numbers at random, all triples."""
    rng, percent = random.Random(5), 80
    linked = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
    past = 0
    for _ in range(20_000):
        hub = set(range(rng.randint(8, 30)))
        x, y = ({e for e in hub if rng.random() < keep} | {100 + rng.randrange(12) for _ in range(rng.choice([0, 0, 1, 3, 6]))} for keep in (rng.random(), rng.random() ** 0.3))
        if rng.random() < 0.6:
            y = {e for e in x if rng.random() < 0.93} | {100 + rng.randrange(12) for _ in range(rng.choice([0, 0, 1, 2]))}
        if not x or not y or not linked(x, y) or (linked(x, hub) and linked(y, hub)):
            continue
        least = lambda s: set(sorted(s - hub)[: len(s) * (100 - percent) // 100 + 1])
        added = bool(least(x) & least(y))
        smaller = any(
            not linked(v, hub) and len(u) < len(hub)
            and (100 + percent) * (len(hub) - max(len(hub - u), len(hub - v))) >= percent * (len(u) + len(v))
            for u, v in ((x, y), (y, x))
        )
        past += smaller and not added
        assert added or smaller
    assert past > 20


def test_rows_that_stay(spark, clashing_docs):
    stay = drop_near_copies(clashing_docs)
    assert stay.columns == clashing_docs.columns
    gone = {r[0] for r in brute(edge_rows(), 5) if not r[3] and r[0] is not None}
    assert Counter(r.doc_id for r in stay.collect()) == Counter(r[0] for r in edge_rows() if r[0] not in gone)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_groups(docs, words=4)) == brute(rows, 4)


def test_empty(no_docs):
    assert near_groups(no_docs).count() == 0
    assert drop_near_copies(no_docs).count() == 0


def test_shingles_against_words():
    texts = [r[1] or "" for r in edge_rows()] + ["", "a", "A b", "É é"]
    for k in (1, 4, 5):
        got = [len(s) for s in shingle_sets([t.encode() for t in texts], k)]
        assert got == [len(shingles(t, k)) for t in texts]
    hashes, counts = word_hashes([b"Abc  abc", b"", b" abc"])
    assert len(set(hashes.tolist())) == 1 and counts.tolist() == [2, 0, 1]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8):
        both = rng.integers(0, 2**64, int(400 * share), np.uint64)
        own = [np.concatenate([both, rng.integers(0, 2**64, (400 - len(both)) // 2, np.uint64)]) for _ in range(2)]
        a, b = near_dedup.signatures(own, 2048)
        assert abs((a == b).mean() - share) < 0.06
