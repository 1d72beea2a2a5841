import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs, dealt over some partitions."""

    def make(pairs, lang="en", repartition=3):
        rows = [Row(doc_id=i, text=t, lang=lang, source="s", n_chars=len(t) if t is not None else None) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(repartition)

    return make


@pytest.fixture
def tables(tmp_path):
    """Writes tables as a folder that queries read."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
