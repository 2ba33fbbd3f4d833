"""Runs queries and their SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    out = query(spark, sf_dir)
    columns = sorted(out.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in out.collect()), key=repr)
    rel = con.execute(sql)
    names, types = [x[0] for x in rel.description], [str(x[1]) for x in rel.description]
    want = rel.fetchall()
    if sorted(names) != columns:
        return f"{name}: columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in order) for r in want), key=repr)
    if "HUGEINT" in types:
        return f"{name}: HUGEINT in {list(zip(names, types, strict=True))}"
    if got != want:
        diff = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), (len(got), len(want)))
        return f"{name}: {len(got)} and {len(want)} rows; {str(diff)[:600]}"
    return None
