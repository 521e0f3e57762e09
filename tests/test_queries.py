"""Registered queries against their SQL on the smallest tables, and their plans."""

import os

import pytest

import workload.all  # noqa: F401
from workload.base import REGISTRY, Inputs
from workload.check import compare, oracle_engine

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")

# one per family here; ``python -m workload.check`` runs them all
FAMILIES = [
    "v1_sanitize", "v5_field_dispatch", "v19_text_clean", "v26_date_finder", "x2_invoice_labels", "x10_layered_merge",
    "x12_tolerant_folder_type", "v4_record_errors", "flagship_verdict_counts", "x5_line_items", "r3_table_markdown",
    "x27_bank_label_cells", "x32_html_items", "x30_items_from_array", "w6_chunk_list", "x20_commission_month",
    "x24_content_fallbacks", "x35_aadhaar_fallbacks", "x9_answer_json", "g9_agreement_lists", "f4_batch_with_failures",
    "g8_tax_from_lines", "m_gst_amounts", "m5_derive_totals", "g7_page_merge", "d2_document_rows", "d4_replace_children",
    "j1_nested_children", "w1_latest_by_name", "k10_update_known_values", "r1_markdown_report", "g4_extraction_summary",
    "s8_key_values", "x15_primary_fields", "invoice_records", "s1_input_folder_scan", "k1_save_records", "k12_output_names",
]


@pytest.fixture(scope="module")
def duck():
    return oracle_engine(SF_DIR)


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_sql(spark, duck, name):
    status, n, _, detail = compare(spark, duck, SF_DIR, name)
    assert status == "ok" and n > 0, detail


@pytest.mark.parametrize("name", [n for n in FAMILIES if not n.startswith("k1_")])
def test_plan_has_no_cross_join(spark, name):
    plan = REGISTRY[name].run(Inputs(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    for line in plan.splitlines():
        if "Join Inner" in line or "Join LeftOuter" in line:
            assert "=" in line, line


def test_scan_reads_only_what_is_used(spark):
    df = REGISTRY["g4_extraction_summary"].run(Inputs(spark, SF_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan


@pytest.mark.parametrize("name", ["x13_merge_dicts", "g10_record_json", "v4_record_verdict", "d1_field_rows_flagged", "x10_layered_merge"])
def test_documents_are_grouped_where_they_are_rendered(spark, name):
    plan = REGISTRY[name].run(Inputs(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    # only the narrow order rows move, by their key; pairs and fields made of them do not
    assert moved and all("hashpartitioning(o_orderkey" in line for line in moved), moved


def test_pieces_of_orders_do_not_grow_with_the_table(spark, monkeypatch):
    import workload.base

    monkeypatch.setattr(workload.base, "DOCUMENTS_A_PIECE", 100)
    orders = Inputs(spark, SF_DIR).table("orders")
    assert orders.rdd.getNumPartitions() == 15 and orders.count() == 1500
