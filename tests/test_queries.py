"""Every query of the library against its SQL on the driver's tables."""

import pytest
from oracle import same

from prismlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_whole_texts_reach_the_parser(spark):
    rows = QUERIES["structured_response_whole"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        whole = ("x" + " ".join(texts[r["doc_id"]].split())).replace(" ", "")
        assert r["description"].replace(" ", "") == whole and r["ocr_text"].replace(" ", "") == (whole if r["doc_id"] % 3 == 1 else "")
    assert max(len(r["description"]) for r in rows if r["doc_id"] % 3 == 0) > 240
