"""Every registered query against its DuckDB twin, and the shape of the plans."""

import compare
import oracle_py
import pytest

import __spark_entry__ as contract
from tallyframe.plans.oracles import ORACLES
from tallyframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"document_fingerprints"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    compare.check(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_documents(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["document_fingerprints"](spark, SF).collect()
    assert {r.doc_id: r.ck for r in rows} == {i: oracle_py.fingerprint(t) for i, t in text.items()}


def test_entry(spark):
    assert contract.entry(spark).count() == 63


WRITERS = {"fingerprint_history_table", "stream_ingest", "stream_coverage", "waterfall_table", "rules_table"}
WRITERS |= {"ingest_late_arrivals", "waterfall_withdrawn_day", "sync_chain"}
WRITERS |= {"rules_from_files", "effectiveness_json", "effectiveness_latest"}
WRITERS |= {"ingest_arrivals", "ingest_changed_days", "executions_rollup", "rollup_redundancy", "rollup_fully_avoided"}
WRITERS |= {"recompute_waterfall", "recompute_coverage", "recompute_effectiveness"}
# Saving layers are shared out over the days of the lookback and the SKUs of a day: windows over a few rows.
SHARED_OUT = {"waterfall_layers", "spend_by_sku", "recompute_counts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_plan(spark, name):
    df = QUERIES[name](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    for bad in ("Python", "Cartesian", "NestedLoop", "MapIn") + (() if name in SHARED_OUT else ("Window ",)):
        assert bad not in plan
    # A fingerprint in a filter would be computed twice per statement.
    assert not [line for line in plan.splitlines() if line.startswith("Condition") and "sha2" in line]
