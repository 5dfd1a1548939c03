"""A helper that holds a result against SQL."""

import duckdb


def differences_to_sql(df, sql, folder):
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = connection.sql(sql)
    got = sorted(map(tuple, df.select(*want.columns).collect()), key=repr)
    return [pair for pair in zip(got, sorted(want.fetchall(), key=repr), strict=True) if pair[0] != pair[1]]
