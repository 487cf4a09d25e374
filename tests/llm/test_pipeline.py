"""The pipeline's stages on the smallest table, each judged on its own input by a plain version."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from brute import components, contained
from samples import ordered
from tokenizers import Tokenizer

import corpus_pipeline
from resona.llm import queries
from resona.llm.frames import map_arrow, stored, table
from resona.llm.quality import quality_scores

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SMALL), "test-stage")
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if name != "tokens":
            assert out.columns == docs.columns
            seen[name] = sorted(r[0] for r in out.select("doc_id").collect())
        if name == "quality":
            scored = quality_scores(docs, table(spark, SMALL, "labels")).filter("predicted = 1")
            assert seen[name] == sorted(r[0] for r in scored.select("doc_id").collect())
            assert len(seen[name]) < len(before)
        elif name == "near copies":
            assert seen[name] == sorted(i for (i, _), (_, c) in components(before, 5, 80).items() if i == c)
        elif name == "test items":
            leaked = {i for i, _ in contained(before, items)}
            assert leaked and seen[name] == sorted(i for i, _ in before if i not in leaked)
        elif name == "mixture":
            assert set(seen[name]) <= {i for i, _ in before} and max(np.bincount(seen[name])) <= 3
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in before)
            assert ordered(out, "doc_id", "n_tokens") == sizes
            starts = sorted(out.select("start", "n_tokens").collect())
            assert [r[0] for r in starts] == np.r_[0, np.cumsum([r[1] for r in starts])[:-1]].tolist()
        docs = out


def test_stages_hand_few_rows_to_workers(spark):
    """All rows of a file's part came as one batch, which filled executors beside what earlier stages had left."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    before = {name: spark.conf.get(name) for name in corpus_pipeline.ROWS}
    try:
        stage = corpus_pipeline.few_rows(lambda _, docs, sf_dir: map_arrow(docs, sizes, "n long"))
        found = [r.n for r in stage(spark, spark.range(2500).coalesce(1), SMALL).collect()]
        assert sum(found) == 2500 and max(found) <= 1000
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
        stage(spark, spark.range(1), SMALL)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "64"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_every_number_has_one_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
