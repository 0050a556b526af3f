import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``{doc_id: text}`` or ``[(doc_id, text), ...]``, in a few partitions."""

    def make(texts, lang="en", source="src1"):
        rows = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def run_query(spark):
    """The rows of a registered query of this subpackage on one of the given scales."""
    from fleetlake.llm.catalog import QUERIES

    def run(name, sf_dir="/root/testdata/sf0.001"):
        return [r.asDict(recursive=True) for r in QUERIES[name](spark, sf_dir).collect()]

    return run
