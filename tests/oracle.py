"""Compare a Spark query with its DuckDB counterpart, exactly and with types."""

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
FAMILIES = {
    "int": ("bigint", "int64"), "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "HUGEINT": "hugeint",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("factorlake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # keep every block of small test tables, so that block borders are exercised
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="factorlake-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def compare(df, con, sql) -> str:
    """Empty when equal, else the first difference."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    types = dict(df.dtypes)
    odd = []
    for name, t in zip(rel.columns, rel.types):
        want = FAMILIES.get(str(t), str(t).lower())
        have = types[name]
        if have != want and not (have.startswith("array") and str(t).endswith("[]")):
            odd.append(f"{name}: {have} vs {t}")
    names = ", ".join(f'"{c}"' for c in cols)
    left = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    right = sorted(tuple(_cell(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({sql}) AS q").fetchall())
    if odd:
        return f"types {odd}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; {left[:2]} vs {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {cols}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else ""


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf = argv.pop(0)
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in argv)]
    failed = []
    for n in names:
        start = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracles:
                msg = compare(df, con, oracles[n])
            else:
                rows = df.collect()
                msg = "" if rows else "no rows"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        spent = time.time() - start
        print(f"{'ok  ' if not msg else 'FAIL'} {n} {spent:.1f}s {'' if n in oracles else '(rows only)'} {msg}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
