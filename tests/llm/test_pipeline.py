"""Every stage of the pipeline against a plain version of it."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import plain

from voxmill.llm import credentials, decontam
from voxmill.llm.queries import quality_sql
from voxmill.llm.shared import read_table


def test_stages(spark, data_dir):
    docs = read_table(spark, data_dir, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{data_dir}/benchmark.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    stages = dict(corpus_pipeline.STAGES)

    good = {row[0] for row in con.execute(f"SELECT doc_id FROM ({quality_sql()}) WHERE kept").fetchall()}
    docs = stages["quality_rules"](spark, docs, data_dir).cache()
    assert {r.doc_id for r in docs.collect()} == good

    named = plain.components(plain.sets_of({k: texts[k] for k in good}, 5))
    single = {key for key, smallest in named.items() if key == smallest}
    docs = stages["near_dedup"](spark, docs, data_dir).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(single)

    items = [decontam.normal(text) for (text,) in con.execute("SELECT text FROM benchmark").fetchall()]
    clean = {k for k in single if not any(item in decontam.normal(texts[k]) for item in items)}
    docs = stages["benchmark_decontamination"](spark, docs, data_dir).cache()
    assert {r.doc_id for r in docs.collect()} == clean

    docs = stages["secret_scans"](spark, docs, data_dir).cache()
    for row in docs.collect():
        assert row.text == credentials.redact(texts[row.doc_id], credentials.scan(texts[row.doc_id])[1])
        assert not plain.strong_spans(row.text) and row.n_chars == len(row.text)
        if not plain.strong_spans(texts[row.doc_id]):
            assert row.text == texts[row.doc_id]

    pieces = stages["tiered_packing"](spark, docs, data_dir).collect()
    assert {p.doc_id for p in pieces} == clean
    again = corpus_pipeline.run(spark, data_dir).collect()
    key = lambda p: (p.doc_id, p.doc_tokens)
    assert {key(p) for p in again} == {key(p) for p in pieces}
