"""Compare registered queries with their SQL on DuckDB: ``python tests/compare.py SF_DIR [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(round(v, 6))
        return repr(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False, name=None))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    kinds = {
        c: (spark_pdf[c].dtype.kind, sql_pdf[c].dtype.kind, str(spark_pdf[c].dtype), str(sql_pdf[c].dtype))
        for c in spark_pdf.columns
    }
    odd = {c: k[2:] for c, k in kinds.items() if k[0] != k[1] and not {k[0], k[1]} <= {"O", "U", "T"}}
    left, right = canonical(spark_pdf), canonical(sql_pdf)
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}; dtypes {odd}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[0]}; dtypes {odd}"
    return f"dtypes {odd}" if odd else None


def main() -> int:
    import __spark_entry__ as entry
    from linkfold.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = differences(got, con.sql(oracles[name]).df()) if name in oracles else "no oracle"
        except Exception as error:  # noqa: BLE001
            got, took, verdict = (), time.time() - start, f"ERROR {str(error)[:1500]}"
        bad += verdict not in (None, "no oracle")
        print(f"{name:32s} {len(got):8d} rows {took:6.2f}s  {verdict or 'ok'}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
