"""The queries on the small tables and the pipeline against its stages done plainly."""

import os
import sys

import public_tokenizers as P
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from pulsegrid.llm import tokenizers  # noqa: E402
from pulsegrid.llm.queries import QUERIES, SQL, table  # noqa: E402
from tests.llm.test_text import brute_components, check_packing, plain_fingerprint  # noqa: E402

CONTRACT = {
    "op1_bpe_trie": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_chat_windows": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3_permutation_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_simhash_covering": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_quality_compression": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_language_cnn": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_cross_polytope": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_pattern_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_license_scan": {"doc_id": "bigint", "path": "string", "license": "string", "similarity": "double", "declared_in": "string"},
    "op10_token_count_cache": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op11_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_drift_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_toxicity_lexicon": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert dict(frame.dtypes) == CONTRACT[name]
    whole = {"op1_bpe_trie", "op4_simhash_covering", "op5_quality_compression", "op6_language_cnn", "op9_license_scan", "op10_token_count_cache", "op13_toxicity_lexicon"}
    if name in whole:
        assert frame.count() == table(spark, sf_dir, "documents").count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir):
    docs, kept = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert len(kept[0]) >= 0.98 * len(first) and set(kept[2]) <= set(kept[1]) <= set(kept[0])
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    assert len(good & set(kept[1])) >= 0.95 * len(good & set(kept[0]))
    ids = sorted(kept[1])
    label = brute_components([plain_fingerprint(kept[1][i]) for i in ids])
    assert set(kept[2]) == {ids[c] for c in set(label)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, 4096)
    model = tokenizers.load(P.path("word_bpe_49k.json"), True)
    _, n = model.encode_whole([kept[2][i] for i in sorted(kept[2])])
    lengths = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == dict(zip(sorted(kept[2]), (n + 1).tolist(), strict=True))


def test_pipeline_on_empty_odd_and_repeated_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(900001, None, None, None, None), (None, "The house", "en", "s", 1), (900002, "", "en", "s", 0)], docs.schema)
    for rows, least in ((docs.union(docs.limit(30)).union(odd), 100), (odd, 0), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, rows, sf_dir)
            rows = spark.createDataFrame(done.collect(), done.schema)
        assert rows.count() >= least
        assert rows.groupBy("doc_id", "piece").count().where("count > 1").count() == 0
