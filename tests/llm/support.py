"""Fixtures shared by the tests of the training-data operators."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, spans string, "
          "text_hash long, start int, kept string, _row int, copies int, `odd name` string")


def corpus(spark, rows):
    """``rows`` of (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, 7, "x", 7, 7, "x", 7, 7, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return con.sql(sql).df()


def same(df, other):
    cols = sorted(df.columns)
    a = sorted(map(str, df.select(*cols).toPandas().itertuples(index=False, name=None)))
    b = sorted(map(str, other[cols].itertuples(index=False, name=None)))
    return a == b


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "word " * 3000), (5, "word " * 3000), (5, "another text"),
        (None, "no id here at all"), (None, None), (6, "a" * 20000)]
