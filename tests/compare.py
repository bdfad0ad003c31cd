"""Compare a Spark result with a DuckDB result, column names, types and rows."""

import math

import duckdb
import pandas as pd

from terraloom.sources.fixtures import TABLES


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def rows(table):
    pdf = table.to_pandas()
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def kind(t):
    for word in ("large_", "child: ", "element: ", "item: ", "l: "):
        t = t.replace(word, "")
    return t.replace("date32[day]", "date")


def differences(spark_table, duck_table):
    """List of texts; empty when both agree."""
    out = []
    a = {f.name: kind(str(f.type)) for f in spark_table.schema}
    b = {f.name: kind(str(f.type)) for f in duck_table.schema}
    if a != b:
        out.append(f"schema {set(a.items()) ^ set(b.items())}")
    ca, ra = rows(spark_table)
    cb, rb = rows(duck_table)
    if ca == cb and ra != rb:
        sa, sb = set(ra), set(rb)
        out.append(f"rows {len(ra)}/{len(rb)} {ca}")
        out.append(f"only spark {len(sa - sb)} {sorted(sa - sb, key=repr)[:3]}")
        out.append(f"only duck {len(sb - sa)} {sorted(sb - sa, key=repr)[:3]}")
    return out
