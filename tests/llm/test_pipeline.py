"""The pipeline stage by stage against brute force, and as a whole."""

import public_tokenizers
from cases import documents, edge, empty, folder  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from fieldline.llm import mixing, quality


def test_run_equals_brute_force(spark, folder, documents):
    rules = quality.rules(F.col("counts"))
    counted = quality.with_counts(documents)
    key = mixing._key(mixing.SEED, "doc_id", "source", "text").alias("key")
    rows = counted.select("doc_id", "text", "source", key, "counts", F.struct(*[v.alias(n) for n, v in rules.items()]).alias("votes")).collect()
    odds = brute.em([r.votes.asDict() for r in rows], quality.believed)
    docs = [(r.doc_id, r.text) for r in rows if not brute.base_failed(r.counts) and odds(r.votes) >= 0]
    roots = brute.components([i for i, _ in docs], [brute.fingerprint(t) for _, t in docs])
    docs = [d for d, root in zip(docs, roots) if d[0] == root]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [d for d, found in zip(docs, brute.contamination([t for _, t in docs], items)) if not found[1]]
    about = {r.doc_id: (r.key, r.doc_id, r.source, r.text) for r in rows}
    mixed = [(row[1], row[3]) for *_, row in brute.mixed([about[i] for i, _ in docs], mixing.BLOCK_CHARS)]
    assert mixed != sorted(mixed)
    want = sorted(brute.token_rows(mixed, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), as_given=True))
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want


def test_stages_keep_the_columns(spark, folder, edge, empty):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near_duplicates" in names
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == edge.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
