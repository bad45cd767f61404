"""Compare a query's rows with its SQL run by DuckDB on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def differences(df, sql: str, sf_dir: str) -> list[str]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(names)} and {sorted(df.columns)}"]
    order = sorted(names)
    want = sorted([tuple(_norm(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(_norm(r[c]) for c in order) for r in df.collect()], key=repr)
    if len(want) != len(got):
        return [f"{len(want)} rows in SQL, {len(got)} in Spark; {want[:2]} {got[:2]}"]
    return [f"{a} in SQL, {b} in Spark" for a, b in zip(want, got, strict=True) if a != b and any(x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True))]
