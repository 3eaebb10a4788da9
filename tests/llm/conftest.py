import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The smallest documents table as rows in id order."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
