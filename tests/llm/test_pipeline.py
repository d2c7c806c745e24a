"""The pipeline end to end, and the entry without the operators."""

import subprocess
import sys

import corpus_pipeline
import pytest

from raresight.llm import toxicity
from raresight.llm.queries import QUERIES
from tests.compare import differences, oracle_connection
from tests.conftest import SF
from tests.llm.test_mixing_packing import check_packing
from tests.llm.test_pairs import fingerprint, near_lines


@pytest.mark.parametrize("key", [k for k, (_, sql) in QUERIES.items() if sql])
def test_sql(key, spark):
    fn, sql = QUERIES[key]
    assert differences(fn(spark, SF).toPandas(), oracle_connection(SF).execute(sql).df()) == ""


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != "packing":
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in schema]
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()])
        docs = spark.createDataFrame(seen[name][1], schema) if name != "packing" else None
    before, after = seen["toxicity"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    # eleven toxic rows train the model here
    assert len(gone & toxic) >= 0.5 * len(toxic) and toxicity.REJECT == 0.5
    before, after = seen["line dedup"]
    want = {r["doc_id"]: t for r, t in zip(before, near_lines([(r["doc_id"], r["text"]) for r in before]))}
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, t in want.items() if t.split() or not next(r for r in before if r["doc_id"] == i)["text"].split()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["simhash near-dedup"]
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in before}
    kept = {r["doc_id"] for r in after}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert kept == set(root.values())
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["packing"]
    assert check_packing([(r["doc_id"], r["text"]) for r in before], after) > 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_entry_without_operators():
    code = "import sys; sys.modules['raresight.llm.queries'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'] and len(e.queries()) > 100"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=120, check=False).returncode == 0
