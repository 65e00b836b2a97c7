import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t) if t is not None else None, 1, "x") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, rank int, start string",
        )

    return build
