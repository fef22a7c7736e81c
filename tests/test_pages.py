import pytest

from docloom.sources import documents

B = "doc_id bigint, block_index int, page int"


def test_each_document_needs_the_selected_pages(spark):
    rows = [(1, 0, 1), (1, 1, 4), (2, 0, 1), (2, 1, 2)]
    documents.check_pages(spark.createDataFrame(rows, B), [(1, 2)])
    with pytest.raises(ValueError, match="there are 2"):
        documents.check_pages(spark.createDataFrame(rows, B), [(1, 1), (3, 3)])
    for unpaged in ([(1, 0, 3), (2, 0, None)], []):
        with pytest.raises(ValueError, match="no pages"):
            documents.check_pages(spark.createDataFrame(unpaged, B), [(1, 1)])
