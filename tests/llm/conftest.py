import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def documents(sf):
    """The documents of the smallest tables as (doc_id, text) rows."""
    table = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
