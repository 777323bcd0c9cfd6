import random
import zlib
from collections import Counter

import numpy as np
import pytest

from windrow.llm import toxicity
from windrow.llm.toxicity import BUCKETS, LENGTHS, Model, drop_toxic, fit, train

from .conftest import edge_rows, words


def brute_score(model, text):
    """N-gram by n-gram, within words and their borders."""
    total, count = 0.0, 0
    low = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in f" {text.lower()} ")
    mask = 0xFFFFFFFF
    for n in LENGTHS:
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if " " in g[1:-1]:
                continue
            h = ord(g[0]) * 0x01000193 & mask
            for c in g[1:]:
                h = (h * 0x85EBCA6B + ord(c)) & mask
            h ^= h >> 15
            h = h * 0x2C1B3C6D & mask
            h ^= h >> 13
            total += float(model.weights[h & (BUCKETS - 1)])
            count += 1
    return 1 / (1 + np.exp(-(total / max(count, 1) + model.bias)))


def test_scores_against_brute_force():
    model = Model(np.random.default_rng(2).normal(0, 30, BUCKETS).astype(np.float32), -0.5)
    texts = [(r[1] or "")[:3000] for r in edge_rows()] + ["", "a", "İ x", "ab"]
    assert model.scores(texts) == pytest.approx([brute_score(model, t) for t in texts], abs=1e-6)
    assert [model.scores([t])[0] for t in texts] == pytest.approx(model.scores(texts).tolist())


def test_unseen_misspellings_score_like_their_word():
    rng = random.Random(4)
    clean = [words(rng, 40) for _ in range(300)]
    toxic = [" ".join(rng.choice(["wretched", "vermin"]) if i % 15 == 0 else w for i, w in enumerate(words(rng, 45).split())) for _ in range(300)]
    model = train(clean + toxic, [0] * 300 + [1] * 300, [1.0] * 600)
    plain = words(rng, 40)
    score = lambda w: model.scores([" ".join(w if i % 12 == 0 else x for i, x in enumerate(plain.split()))])[0]
    assert score("wretchhed") > 0.5 and score("VERMINN") > 0.5 and model.scores([plain])[0] < 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_edge_rows_and_clashing_names(spark, clashing_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(clashing_docs, known).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    model = fit(clashing_docs, labels)
    stay = drop_toxic(clashing_docs, labels)
    assert stay.columns == clashing_docs.columns
    assert Counter(r.text for r in stay.collect()) == Counter(r[1] for r in edge_rows() if model.scores([r[1] or ""])[0] < 0.5)
