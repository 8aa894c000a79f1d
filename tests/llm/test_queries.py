"""Contract queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from latticework.llm.queries import ORACLES, QUERIES
from latticework.llm.tables import read_table

from . import test_decontaminate, test_ngram_join, test_packing

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def texts(spark):
    return [(r.doc_id, r.text) for r in read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_registers_all_of_them():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize(("name", "of", "label"), [("op1_toxicity", 4, "toxic"), ("op3_quality_mil", 5, "quality")])
def test_classifiers(spark, name, of, label):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == len(texts(spark)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % of == (2 if of == 4 else 0)) for r in rows)
    known = {r.doc_id: r[label] for r in read_table(spark, FOLDER, "labels").collect()}
    hits = [r.predicted == known[r.doc_id] for r in rows if r.held_out and r.doc_id in known]
    assert sum(hits) >= 0.8 * len(hits)


def test_joins_and_leaks(spark):
    docs = texts(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_ngram_join"](spark, FOLDER).collect()}
    assert got == test_ngram_join.brute(docs, 4, 85, 100)
    items = [(r.item_id, r.text) for r in read_table(spark, FOLDER, "benchmark").collect()]
    found = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, FOLDER).collect()}
    plain = {(d, i) for d, t in docs for i, x in items if x in t}
    assert plain <= found and len(found) <= len(plain) + 2


def test_per_page_queries(spark):
    pages = read_table(spark, FOLDER, "pages")
    for name in ("op5_html_paths", "op8_warc", "op10_url_templates"):
        assert sorted(r.page_id for r in QUERIES[name](spark, FOLDER).collect()) == sorted(r.page_id for r in pages.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cursor.fetchall()))


def test_rule_query(spark):
    rows = QUERIES["op6_rule_forest"](spark, FOLDER).collect()
    assert len(rows) == len(texts(spark)) and all(not r.kept for r in rows if r.base_failed)
    known = {r.doc_id: r.quality for r in read_table(spark, FOLDER, "labels").collect()}
    good = [r.kept for r in rows if known.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.95 * len(good)


def test_pipeline(spark):
    docs, columns = read_table(spark, FOLDER, "documents"), None
    known = {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    columns, now = docs.columns, docs
    items = [(r.item_id, r.text) for r in read_table(spark, FOLDER, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, FOLDER)
        if name != "packing":
            assert out.columns == columns
            rows = {r.doc_id: r.text for r in out.collect()}
            assert set(rows) <= set(before)
            if name != "line_dedup":
                assert all(rows[i] == before[i] for i in rows)
            if name == "near_duplicates":
                assert set(rows) == {i for i, (_, c) in test_ngram_join.brute(list(before.items()), 5, 80, 100).items() if i == c}
            if name == "decontamination":
                gone = {d for d, _ in test_decontaminate.brute([(d, t) for d, t in before.items() if any(x[1][:20].lower() in t.lower() for x in items)], items)}
                assert set(before) - set(rows) == gone
            assert len(rows) >= 0.6 * len(before)
            from latticework.llm.tables import stored

            now = stored(out, "test")
        else:
            pieces = out.collect()
            assert test_packing.check(pieces, before, 2048) < 2048
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in whole} <= known
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))
