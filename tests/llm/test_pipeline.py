"""The registered queries' columns, their SQL, and the pipeline stage by stage."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from compare import oracle, rows

from lodestone.llm import decontaminate, pii, queries

COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op2_embedding_near_dedup": "vec_id n_links component_id kept", "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_html_text": "page_id url text n_chars", "op5_quality_classifier": "doc_id held_out score predicted", "op6_ngram_jaccard_join": "doc_id class_id n_links", "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_substring_dedup": "doc_id n_words n_removed kept_sha256", "op9_source_mixing": "doc_id size source_size target taken", "op10_benchmark_decontamination": "doc_id item_id coverage",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified", "op12_host_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept host_rejected host_watched",
    "op13_ranked_search": "item_id rank doc_id score",
}
ROWS = {"op2": "embeddings", "op4": "pages", "op7": "pages"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert list(got.columns) == COLUMNS[name].split()
    if name not in ("op10_benchmark_decontamination", "op13_ranked_search"):
        assert len(got) == spark.read.parquet(f"{sf_dir}/{ROWS.get(name.split('_')[0], 'documents')}.parquet").count()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(oracle(sf_dir).sql(queries.ORACLE_SQL[name]).df())


def test_stages(spark, sf_dir):
    """Each stage's decisions, seen from what it got and what it gave."""
    from test_texts import classes, greedy, split

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        if name != "mix":
            assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), after.schema)
        got[name] = (before, after)
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    quality = entry.queries()["op5_quality_classifier"](spark, sf_dir)
    assert ids(got["quality"][1]) == ids(quality.where("predicted = 1"))
    met = [(r.doc_id, r.text) for r in got["near_duplicates"][0].select("doc_id", "text").collect()]
    assert ids(got["near_duplicates"][1]) == {i for i, c, _ in classes(met) if i == c}
    items = [split((r.text or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = ids(got["decontamination"][1])
    for r in got["decontamination"][0].collect():
        if len(doc := split((r.text or "").lower())) > 400:
            continue
        tile = decontaminate.TILE
        seeds = {tuple(doc[k : k + tile]) for k in range(len(doc))}
        share = max((greedy(i, doc, tile) / len(i) for i in items if len(i) >= tile and any(tuple(i[k : k + tile]) in seeds for k in range(len(i)))), default=0)
        assert (share < decontaminate.COVER) == (r.doc_id in kept)
    masked = {r.doc_id: r for r in got["pii"][1].collect()}
    for r in got["pii"][0].collect():
        assert not pii.base_spans(r.text or "") or masked[r.doc_id].text != r.text
        assert masked[r.doc_id].n_chars == len(masked[r.doc_id].text)
        assert masked[r.doc_id].source == r.source
    assert ids(got["mix"][1]) == ids(got["pii"][1])


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert {"doc_id", "size", "target", "taken"} <= set(got.columns) and len(got)
    assert corpus_pipeline.ORACLE_SQL is None
