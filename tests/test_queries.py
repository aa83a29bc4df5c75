"""Every registered query of the narration operators against its DuckDB twin; those without one are held against plain loops in other
files, which have to name them."""
import pytest
from oracle import connect, same

from lectern.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        same(df, con, ORACLE[name])
    else:
        assert name in PLAIN and df.columns and not df.isEmpty()


#: Where each query without a twin is compared row by row over its whole tables.
PLAIN = {
    "lay7_span_roles": "test_pages", "lay9_join_lines": "test_pages", "lay11_split_verses": "test_pages", "lay15_page_mode": "test_pages", "lay19_region_signature": "test_pages",
    "lay22_ocr_paragraphs": "test_assembly", "lay24_cluster_boxes": "test_layout", "lay25_merge_boxes": "test_layout", "lay26_figure_candidates": "test_pages",
    "lay29_place_picture_text": "test_assembly", "lay31_pages_to_paragraphs": "test_pages", "lay20_stitch_documents": "test_twins", "src3_extract_articles": "test_web", "sta11_apply_highlight_log": "test_state",
    "str3_stream_highlights": "test_streams", "tim5_sentence_timeline": "test_twins", "txt13_split_sentences": "test_twins"}
