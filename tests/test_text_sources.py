"""Text-table reader: encodings, NA tokens, ragged rows, duplicate headers, types."""
import os

import pytest

from tessera.operators.score import ValidationError
from tessera.sources import text as TX


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_utf8_bom_na_tokens_and_types(spark, tmp_dir):
    body = "\ufeffid,name,score,flag,ratio\n1,a,NA,True,1.5\n2,b,,False,inf\n3,None,7,true, 2e3 \n"
    p = _write(tmp_dir, "a.csv", body.encode("utf-8"))
    df = TX.read_table(spark, p)
    assert df.columns == ["id", "name", "score", "flag", "ratio"]
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["score"] == "bigint" and types["flag"] == "boolean"
    assert types["ratio"] == "double" and types["name"] == "string"
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["score"] is None and rows[2]["score"] is None and rows[3]["score"] == 7
    assert rows[3]["name"] is None
    assert rows[2]["ratio"] == float("inf") and rows[3]["ratio"] == 2000.0


def test_cp950_and_big5_fallback(spark, tmp_dir):
    text = "名稱,數量\n台北,1\n高雄,2\n"
    p = _write(tmp_dir, "b.csv", text.encode("cp950"))
    assert TX.detect_encoding(spark, p) == "cp950"
    df = TX.read_table(spark, p)
    assert df.columns == ["名稱", "數量"]
    assert sorted(r[0] for r in df.collect()) == ["台北", "高雄"]


def test_scoring_reader_is_utf8_only(spark, tmp_dir):
    p = _write(tmp_dir, "c.csv", "名稱,數量\n台北,1\n".encode("cp950"))
    with pytest.raises(ValidationError):
        TX.read_table(spark, p, encodings=TX.SCORING_ENCODINGS)


def test_duplicate_headers_and_short_rows(spark, tmp_dir):
    p = _write(tmp_dir, "d.csv", b"a,a,b\n1,2,3\n4,5\n")
    df = TX.read_table(spark, p)
    assert df.columns == ["a", "a.1", "b"]
    rows = sorted(df.collect(), key=lambda r: r[0])
    assert rows[1]["b"] is None


def test_long_row_is_an_error(spark, tmp_dir):
    p = _write(tmp_dir, "e.csv", b"a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValidationError):
        TX.read_table(spark, p)


def test_empty_and_header_only(spark, tmp_dir):
    with pytest.raises(ValidationError):
        TX.read_table(spark, _write(tmp_dir, "f.csv", b""))
    with pytest.raises(ValidationError):
        TX.read_table(spark, _write(tmp_dir, "g.csv", b"a,b\n"))


def test_quoted_newlines_multiline(spark, tmp_dir):
    p = _write(tmp_dir, "h.csv", b'id,txt\n1,"x, y"\n2,"line1\nline2"\n')
    df = TX.read_table(spark, p, multi_line=True)
    got = {r["id"]: r["txt"] for r in df.collect()}
    assert got == {1: "x, y", 2: "line1\nline2"}


def test_integer_column_with_missing_stays_integer(spark, tmp_dir):
    df = TX.read_table(spark, _write(tmp_dir, "i.csv", b"k,v\n1,10\n2,\n3,30\n"))
    assert dict(df.dtypes)["v"] == "bigint"


def test_dedupe_header_rule():
    assert TX.dedupe_header(["a", "a", "a.1", "b", "a"]) == ["a", "a.1", "a.1.1", "b", "a.2"]


def test_json_request_bodies_data_or_records(spark):
    from pyspark.sql import types as T
    from tessera.sources.records import records_from_bodies
    schema = T.StructType([T.StructField("Area", T.DoubleType()), T.StructField("Room", T.LongType())])
    ok = spark.createDataFrame([('{"data": [{"Area": 1.0, "Room": 2}, {"Area": null, "Room": 3}]}',),
                                ('{"records": [{"Area": 5.0}]}',)], "body string")
    rows = records_from_bodies(ok, "body", schema).collect()
    assert len(rows) == 3 and sum(r["Area"] is None for r in rows) == 1 and sum(r["Room"] is None for r in rows) == 1
    for bad in ('{"data": [{"Area": 1.0}], "records": [{"Area": 2.0}]}', '{"data": []}', '{"other": 1}'):
        df = spark.createDataFrame([(bad,)], "body string")
        with pytest.raises(Exception):
            records_from_bodies(df, "body", schema).collect()
