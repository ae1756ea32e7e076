"""CSV in splits of any size against a parser that goes one character at a time."""

import random

import pytest

from folioflow.sources import files


def sequential(source):
    """Records as lists of cells, and whether a quote is left open."""
    rows, row, cell, quoted, k = [], [], "", False, 0
    source = source.removeprefix("﻿")
    while k < len(source):
        c = source[k]
        if quoted:
            if c == '"' and source[k + 1 : k + 2] == '"':
                cell, k = cell + '"', k + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = True
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        elif c != "\r":
            cell += c
        k += 1
    return (rows if not cell and not row else [*rows, [*row, cell]]), quoted


@pytest.mark.parametrize("split", [1 << 20, 40])
def test_records_equal_a_sequential_parser(spark, tmp_path, split):
    rng = random.Random(split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        for k in range(12):
            text = "".join(rng.choice(['"', '"', '""', ",", "\n", "\n", "\r\n", "a", "é", "word", " "]) for _ in range(rng.randint(0, 150)))
            (tmp_path / str(k)).mkdir()
            for j in range(2):
                (tmp_path / str(k) / f"{j}.csv").write_text(("﻿" if j else "") + text + "x" * j, encoding="utf-8", newline="")
            got = files.csv_records(spark, str(tmp_path / str(k))).collect()
            for j in range(2):
                want, open_quote = sequential(text + "x" * j)
                mine = sorted((r.record, r.fields) for r in got if r.path.endswith(f"/{j}.csv"))
                assert all(r.closed for r in got) or open_quote
                if not open_quote:
                    assert [f for _, f in mine if f != [""]] == [f for f in want if f != [""]] and [n for n, _ in mine] == list(range(len(mine)))
                else:
                    assert [f for _, f in mine][: len(want) - 1] == want[:-1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def put(tmp_path, text):
    (tmp_path / "t.csv").write_text(text, encoding="utf-8", newline="")
    return str(tmp_path / "t.csv")


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ('n,t\n1,"x\n2,y\n', "record 1: a quote is left open"), ("n,t\n1,x,y\n", "record 1: 3 cells instead of 2"), ("n,t\n\n1,x\n2\n", "record 3: 1 cells instead of 2"), ("n,t\nx,y\n", "record 1: no int in n"),
        ("t,n\n1,x\n", "record 0: other names"), ("n,n\n1,x\n", "record 0: a name twice"), ("n,t\n", "no rows"), ("\n \n", "no rows"), ("", "no rows"),
    ],
)
def test_errors(spark, tmp_path, text, problem):
    with pytest.raises(ValueError, match=problem):
        files.read_csv(spark, put(tmp_path, text), "n int, t string")


def test_strict_rows(spark, tmp_path):
    path = put(tmp_path, '﻿n, t \r\n1,"a ""b""\r\nc,"\r\n\r\n,x\r\n3,\n')
    assert sorted(map(tuple, files.read_csv(spark, path, "n int, t string").collect()), key=str) == sorted([(1, 'a "b"\r\nc,'), (None, "x"), (3, None)], key=str)
