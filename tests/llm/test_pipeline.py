import os
import re

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import common

from .test_jaccard_join import WORD, brute

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_stages_equal_brute_force(spark):
    import public_tokenizers
    import sentencepiece

    docs, seen = common.table(spark, D, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, D), "stage")
        seen.append({r.doc_id: r for r in docs.collect()})
    cleaned, single, clean, redacted, encoded = seen
    component = {i: c for i, (_, c) in brute([(i, r.text) for i, r in cleaned.items()]).items()}
    assert set(single) == {i for i in cleaned if component[i] == i}

    def grams(text):
        ws = WORD.findall(text.lower())
        return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    items = [grams(r.text) for r in common.table(spark, D, "benchmark").collect()]
    hit = {i for i, r in single.items() for g in [grams(r.text)] if any(q and 100 * len(q & g) >= 80 * len(q) for q in items)}
    assert hit and set(clean) == set(single) - hit
    assert set(redacted) == set(clean) and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) for r in redacted.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(np.frombuffer(encoded[i].ids, "<u4").tolist() == sp.encode(r.text, add_bos=True, add_eos=True) for i, r in redacted.items())


def test_run_on_no_rows(spark, tmp_path):
    common.table(spark, D, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, D, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
