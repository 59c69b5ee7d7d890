"""Queries over the hits of the stated questions read the blocks of asked terms: none builds the index of all postings, which took most of their time."""

import pytest

import __spark_entry__ as entry
from mosaiq.plans import views

QUERIES = (
    "candidates",
    "link_pack",
    "pack_selected",
    "search_unsent",
    "answers",
    "file_score_blend",
    "judge_select",
    "link_score_expand",
    "proxy_judge",
    "seed_nms",
    "bm25_typed_search",
    "fact_overlap",
    "full_pack",
    "pack_recall",
    "pointer_pack",
    "retrieval_recall",
    "search_min_score",
    "symbol_score_blend",
)


@pytest.mark.parametrize("name", QUERIES)
def test_it_needs_no_index_of_all_postings(spark, monkeypatch, name):
    def index(*_):
        raise AssertionError("the whole index was built")

    monkeypatch.setattr(views, "index", index)
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
