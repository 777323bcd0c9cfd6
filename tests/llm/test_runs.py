import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from windrow.llm import runs
from windrow.llm.queries import op13_periodic_runs

from .conftest import DOCS, edge_rows


def brute(w, least=12):
    """Every period at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k < len(w) - q:
            end = k
            while end < len(w) - q and w[end] == w[end + q]:
                end += 1
            if end - k + q >= max(least, 2 * q):
                found.setdefault((k, end - k + q), q)
            k = max(end, k + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    kind = rng.random()
    if kind < 0.3:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.5:
        return [0] * n
    if kind < 0.8:
        block = [rng.randint(0, 5) for _ in range(rng.randint(1, 20))]
        w = (block * (n // len(block) + 1))[:n]
        if n and rng.random() < 0.7:
            w[rng.randrange(n)] = 9
        return w
    a, b = [0], [1]  # Fibonacci words have very many runs
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 12])
@pytest.mark.parametrize("step", [50, 500_000])
def test_against_brute_force(monkeypatch, least, step):
    monkeypatch.setattr(runs, "STEP", step)
    rng = random.Random(least + step)
    for _ in range(60):
        texts = [some_words(rng, rng.choice([0, 1, 2, 11, 12, 13, 30, 100, 200])) for _ in range(rng.randint(0, 8))]
        got = runs.runs_of([np.array(w, np.int64) for w in texts], least)
        assert [[tuple(r) for r in own.tolist()] for own in got] == [brute(w, least) for w in texts]


def test_extensions():
    rng = random.Random(1)
    for _ in range(40):
        w = some_words(rng, rng.randint(1, 300))
        asked = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
        rng.shuffle(asked)
        asked = asked[:2000]
        if not asked:
            continue
        got = runs.Extensions(np.array(w, np.int64)).lengths(*(np.array(x) for x in zip(*asked)))
        for (i, j), n in zip(asked, got.tolist()):
            want = 0
            while max(i, j) + want < len(w) and w[i + want] == w[j + want]:
                want += 1
            assert n == want


def test_long_text():
    """A period of thousands of words, and one word for ever."""
    for w, want in ((np.arange(30_000) % 9_000, [(0, 30_000, 9_000)]), (np.zeros(30_000, np.int64), [(0, 30_000, 1)])):
        (got,) = runs.runs_of([w])
        assert [tuple(r) for r in got.tolist()] == want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def described(rows, change=changed):
    out = Counter()
    for r in rows:
        w = change(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        found = brute(w) if len(w) < 5_000 else None
        if found is None:  # too long for every period: what is known of it
            continue
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda f: (f[1], -f[0], -f[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out[r[0], len(found), *top, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def got(df, rows):
    long = {r[0] for r in rows if len((r[1] or "").split()) >= 5_000}
    return Counter(tuple(r) for r in df.collect() if r.doc_id not in long)


def test_edge_rows(clashing_docs):
    found = runs.run_digests(clashing_docs, runs.repeated)
    assert found.count() == len(edge_rows())
    assert got(found, edge_rows()) == described(edge_rows())


def test_repeats_collapse(spark):
    block = " ".join(f"w{i}" for i in range(7))
    rows = [(1, f"x {block} {block}\t{block} y", "en", "s", 0), (2, "a " * 12, "en", "s", 0), (3, "a " * 11, "en", "s", 0), (None, "b " * 30, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in runs.word_runs(docs).collect()} == {(1, 1, 21, 7), (2, 0, 12, 1), (None, 0, 30, 1)}
    assert {r.doc_id: r.text for r in runs.collapse_runs(docs).collect()} == {1: f"x {block} y", 2: "a", 3: " ".join("a" * 11), None: "b"}


def test_one_text_for_all(spark):
    """A third of all rows are copies, over several batches."""
    rows = [(i, " ".join(["p", "q", "r"] * 20) if i % 3 == 0 else f"only {i}", "en", "s", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(runs.run_digests(docs, runs.repeated), rows) == described(rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op13_periodic_runs(spark, sf_dir), rows) == described(rows)


def test_empty(no_docs):
    assert runs.run_digests(no_docs).collect() == []
    assert runs.word_runs(no_docs).collect() == []
    assert runs.collapse_runs(no_docs).collect() == []
