import pytest


@pytest.fixture()
def docs(spark):
    """A builder of small documents tables, with columns whose names clash with those of results."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + ", length long, bucket int, sid long, c string" * extra
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""))[:4] + (len(r[1] or ""),) + ((1, 2, 3, "x") if extra else ()) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
