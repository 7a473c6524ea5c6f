"""Compare every registered query with its SQL on one scale factor.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

import decimal
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
            if not isinstance(v, list):
                return one(v)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        return str(v)

    for c in df.columns:
        df[c] = [one(v) for v in df[c].astype(object)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(got, want) -> str:
    g, w = got.toPandas(), want.to_pandas() if hasattr(want, "to_pandas") else want
    if sorted(g.columns) != sorted(w.columns):
        return f"COLUMNS {sorted(g.columns)} vs {sorted(w.columns)}"
    if len(g) != len(w):
        return f"ROWS {len(g)} vs {len(w)}"
    a, b = canon(g), canon(w)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = int(bad.idxmax())
        return f"VALUES {int(bad.sum())} rows differ\n   spark {a.loc[i].to_dict()}\n   sql   {b.loc[i].to_dict()}"
    return "ok"


def kinds(df_types, rel_types):
    return {c: (df_types[c], rel_types.get(c)) for c in df_types}


def main():
    import __spark_entry__ as E
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for n, q in qs.items():
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            df = q(spark, sf)
            if n in sql:
                rel = con.execute(sql[n])
                want = rel.df()
                types = {d[0]: str(d[1]) for d in rel.description} if rel.description else {}
                res = compare(df, want)
                fam = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
                off = {c: (ty, types.get(c)) for c, ty in df.dtypes if c in types and fam.get(ty, "?") != types.get(c) and ty in fam}
                if off:
                    res += f"  TYPES {off}"
            else:
                res = f"rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e)[:1500]
        bad += not (res == "ok" or res.startswith("rows="))
        print(f"{n:34s} {time.time() - t:6.1f}s  {res}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
