"""The pipeline's stages on odd rows, and the whole against a brute-force version."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_and_exact import classes_of, plain_cut, plain_fingerprint
from tidegauge.llm import byte_bpe


@pytest.fixture(scope="module")
def sf_dir(spark, odd_docs, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "word1 shared word2 shared word3 shared word4 shared word5 shared word6 shared word7 shared"), (2, "x"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir, name, stage):
    out = stage(spark, odd_docs, sf_dir)
    if stage is not corpus_pipeline.bpe_stage:
        assert out.columns == odd_docs.columns
        assert {r.fp for r in out.select("fp").collect()} == {"7"}
    else:
        assert out.count() == odd_docs.count()
    assert stage(spark, no_docs, sf_dir).collect() == []


def test_whole_pipeline_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The fitted scores decide the first stage; what follows is computed anew here.
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.toxicity_stage(spark, docs, sf_dir).collect()]
    label = classes_of([plain_fingerprint(t) for _, t in rows], 4)
    kept = []
    for k in sorted(set(label)):
        own = [r for r, other in zip(rows, label) if other == k]
        known = [r for r in own if r[0] is not None]
        kept.append(min(known, key=lambda r: r[0]) if known else own[0])
    cut = [(i, None if t is None else new.decode("utf-8", "ignore")) for (i, t), new in zip(kept, plain_cut([(t or "").encode() for _, t in kept]))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = []
    for i, t in cut:
        n, hit, _ = brute(t, items, 13)
        if not (hit and 20 * len(hit) >= n):
            clean.append((i, t))
    ranks = byte_bpe.load_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((i, tuple(other.encode_ordinary(t or ""))) for i, t in clean)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
