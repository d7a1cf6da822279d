"""Compares a query's rows with its SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(df, sql, sf_dir, out):
    """Rows that only one side has, and columns whose types differ."""
    df.write.mode("overwrite").parquet(out)
    con = connect(sf_dir)
    got = f"select * from '{out}/*.parquet'"
    a, b = ({r[0]: r[1] for r in con.execute(f"describe {q}").fetchall()} for q in (got, sql))
    assert set(a) == set(b)
    cols = ", ".join(f'"{c}"' for c in sorted(a))
    one = con.execute(f"select {cols} from ({sql}) except all select {cols} from ({got})").fetchall()
    two = con.execute(f"select {cols} from ({got}) except all select {cols} from ({sql})").fetchall()
    return one[:3], two[:3], {c: (a[c], b[c]) for c in a if a[c] != b[c]}
