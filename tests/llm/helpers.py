"""Small frames for the operators' edge cases, and comparison with SQL."""

import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, n_lines string, kept string"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names an operator might use itself."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), 1, 7, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOC)


def oracle(sql, sf_dir=SF_DIR):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def as_rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).values))
