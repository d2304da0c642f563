"""What the physical plans must look like: pruned scans, no Python in metadata work, no needless exchange."""

from __future__ import annotations

import re

import pytest

from granary.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PYTHON = re.compile("Python|MapInArrow|MapInPandas|FlatMapGroupsInArrow|ArrowEval")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("consolidation", "migrate_commit_full")) and n not in ("migrate_keep_originals", "migrate_summary")))
def test_metadata_stays_in_the_jvm(spark, name):
    assert not PYTHON.search(plan(QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["smart_resize_plan", "recompress_plan", "mip_chain", "total_mip_bytes", "name_hash", "path_parts", "search_textures", "payload_sha", "rsc7_page_flags"])
def test_row_work_needs_no_exchange(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, DATA))


def test_scans_read_what_they_need(spark):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["dup_null_payload_excluded"](spark, DATA)))
    assert found and all("lang" not in x for x in found)
    text = plan(QUERIES["import_filter"](spark, DATA))
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_duplicates_are_counted_before_the_exchange(spark):
    text = plan(QUERIES["dup_by_hash"](spark, DATA))
    assert "partial_count" in text and "Window" not in text
