import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A shared folder where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tmp_path_factory.mktemp("shared").as_uri())


@pytest.fixture
def docs(spark):
    """Documents with null, empty and repeated rows, and a column that clashes."""

    def make(rows, schema="doc_id long, text string", **extra):
        return spark.createDataFrame(rows, schema)

    return make
