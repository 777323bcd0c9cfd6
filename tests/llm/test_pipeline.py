from collections import Counter

import corpus_pipeline
from windrow.llm.queries import WORD_BPE
from windrow.llm.toxicity import fit
from windrow.storage import intermediates

from . import test_exact_dedup, test_mixing, test_near_dedup, test_tokens
from .conftest import edge_rows


def test_stages_against_plain_versions(spark, edge_docs, tmp_path):
    """Every stage on what the plain version of the one before keeps."""
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = fit(edge_docs, labels)
    rows = [r for r in edge_rows() if model.scores([r[1] or ""])[0] < 0.5]
    kept, left = [], Counter()
    for (i, _, _, stays, sha), n in test_exact_dedup.brute(rows).items():
        left[i, sha] += n * stays
    for r in sorted(rows, key=lambda r: tuple(str(x) for x in r)):
        (key,) = [(i, sha) for i, _, _, _, sha in test_exact_dedup.brute([r])]
        if left[key] > 0:
            left[key] -= 1
            kept.append(r)
    gone = {r[0] for r in test_near_dedup.brute(kept, 5) if not r[3] and r[0] is not None}
    kept = [r for r in kept if r[0] not in gone]
    path, end = WORD_BPE
    want = Counter()
    for r, _, _, _, copies in test_mixing.brute(kept):
        (found,) = test_tokens.expected(path, end, [r])
        ids = found[1]
        for s in range(0, len(ids), 2048):
            want[r[0], s, len(ids[s : s + 2048]), test_tokens.crc(ids[s : s + 2048]), len(ids)] += copies
    with intermediates(spark):
        got = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
