"""Text tables with line ends inside cells, read in splits."""

import csv
import io
import os
import random

import pytest

from tessera.operators.score import ValidationError
from tessera.session import sql_conf
from tessera.sources import text as TX


def _cell(rnd):
    return rnd.choice(["", "plain", "a,b", 'say "hi"', "two\nlines", "\n", ",\n,\"", "é中", "x" * 300 + "\n" + "y" * 200, ' lead, "q"\n', "1", "a\n\n\nb", '"'])


def _table(n, seed):
    rnd = random.Random(seed)
    return [[str(i)] + [_cell(rnd) for _ in range(3)] for i in range(n)]


def _write(path, header, rows, eol="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=eol)
    w.writerow(header)
    w.writerows(rows)
    with open(path, "wb") as f:
        f.write(out.getvalue().encode())


HEADER = ["id", "name, full", "note\nlong", 'the "x"']


@pytest.mark.parametrize("split", [150, 1000, 1 << 27])
def test_records_do_not_depend_on_splits(spark, tmp_dir, split):
    """Two files, each of many splits; cells longer than a split, splits without a quote."""
    a, b = _table(40, 1), _table(25, 2)
    long = [["x1", "start\n" + "\n".join(f"line {i}" for i in range(30)) + "\nend", "z", "z"], ["x2", "p", "q", "r"]]
    for row in b:
        row[0] = "b" + row[0]
    _write(os.path.join(tmp_dir, "1.csv"), HEADER, a + long)
    _write(os.path.join(tmp_dir, "2.csv"), HEADER, b, "\r\n")
    with sql_conf(spark, spark__sql__files__maxPartitionBytes=str(split), spark__sql__files__openCostInBytes="1"):
        df = TX.read_table(spark, tmp_dir, infer=False)
        assert df.columns == HEADER
        if split == 150:
            assert df.rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in df.collect())
    want = sorted(tuple(None if x in ("",) else x for x in row) for row in a + long + b)
    assert got == [tuple(w) for w in want] or sorted(map(repr, got)) == sorted(map(repr, want))


def test_quotes_inside_plain_cells_and_after_cells_open_nothing():
    for line, outside, inside in [('a,b', False, True), ('"a",b', False, False), ('"a', True, False), ('a,"b', True, False), ('5" pipe,x', False, False),
                                  ('"a ""b"" c', True, False), ('x"', False, False), ('"",""', False, True), ('""', False, True), ('"",\"', True, True),
                                  ('', False, True), ('","', False, True), ('a,"b",c,"d', True, False)]:
        assert TX.ends_inside(line, False, ",") is outside, line
        assert isinstance(TX.ends_inside(line, True, ","), bool)
    assert TX.ends_inside('b",c', True, ",") is False and TX.ends_inside('b",""', True, ",") is False
    assert TX.ends_inside('b""c', True, ",") is True and TX.ends_inside('b","c', True, ",") is True


def test_a_plain_file_uses_the_plain_reader(spark, tmp_dir):
    p = os.path.join(tmp_dir, "p.csv")
    _write(p, ["a,b", "c"], [["1", 'say "hi"'], ["2", "x,y"]])
    assert TX.records(spark, p) is None
    df = TX.read_table(spark, p)
    assert df.columns == ["a,b", "c"] and sorted(tuple(r) for r in df.collect()) == [(1, 'say "hi"'), (2, "x,y")]


def test_long_rows_short_rows_and_open_cells(spark, tmp_dir):
    def path(name, data):
        p = os.path.join(tmp_dir, name)
        with open(p, "wb") as f:
            f.write(data)
        return p

    short = TX.read_table(spark, path("s.csv", b'a,b\n"1\n2",x\n\n3\n'))
    assert sorted(map(tuple, short.collect())) == [("1\n2", "x"), ("3", None)]
    with pytest.raises(ValidationError, match="more fields"):
        TX.read_table(spark, path("l.csv", b'a,b\n"1\n2",x,y\n'))
    with pytest.raises(ValidationError, match="not closed"):
        TX.read_table(spark, path("o.csv", b'a,b\n"1\n2,x\n3,4\n'))
    with pytest.raises(ValidationError, match="data row"):
        TX.read_table(spark, path("h.csv", b'a,"b\nc"\n'))
    legacy = TX.read_table(spark, path("big.csv", '名稱,"數\n量"\n"台\n北",1\n'.encode("cp950")))
    assert legacy.columns == ["名稱", "數\n量"] and legacy.first()[0] == "台\n北"
    bom = TX.read_table(spark, path("bom.csv", '﻿a,"b\nc"\n1,"x\ny"\n'.encode()))
    assert bom.columns == ["a", "b\nc"] and tuple(bom.first()) == (1, "x\ny")


def test_written_tables_read_back(spark, tmp_dir):
    rows = [(i, v) for i, v in enumerate([' lead and trail ', 'q "q"', "a\nb", "c,d", "\\", 'back \\" slash', "\ttab"])]
    df = spark.createDataFrame(rows, "i int, `the, text` string")
    p = TX.write_table(df, os.path.join(tmp_dir, "w"))
    back = TX.read_table(spark, p)
    assert back.columns == ["i", "the, text"] and sorted(map(tuple, back.collect())) == rows
