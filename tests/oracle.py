"""Runs registered queries and their SQL twins on the same tables, and compares sorted rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    names = [columns[k] for k in order]
    plain = lambda v: float(v) if isinstance(v, float) and not math.isnan(v) else v
    return names, sorted((tuple(plain(r[k]) for k in order) for r in values), key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (bool, int, float)) else (v is None, "", float(v)) for v in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b and type(a) is type(b)


def compare(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = rows(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if not all(map(same, g, w)):
            return f"{dict(zip(got_names, g, strict=True))} against {w}"
    return None if got else "no rows"
