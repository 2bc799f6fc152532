import numpy as np
import pytest

from sundew.llm import repetition as R


@pytest.mark.parametrize("crf", [R.LineCrf(), R.trained()], ids=["retains all", "trained"])
def test_share_whatever_the_labels(spark, crf):
    word = (f"w{i}" for i in range(10_000))
    said = " ".join(next(word) for _ in range(8))
    small = "\n".join([" ".join(next(word) for _ in range(88)), said + " x", said + " y"] + [" ".join(next(word) for _ in range(10)) for _ in range(7)])
    half = " ".join([said, *(next(word) for _ in range(8)), said, *(next(word) for _ in range(8))])
    df = spark.createDataFrame([(1, small), (2, half), (3, "no word is said again"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in R.repetition(df, crf=crf).collect()}
    assert [rows[i].repeated_share for i in range(1, 5)] == [16 / 176, 0.5, 0.0, 0.0]
    assert all(r.retained == (1 - r.boilerplate_share > 0.6) for r in rows.values())
    if np.all(crf.emit == 0):
        assert all(r.retained for r in rows.values())
