"""Compare every query with its SQL: python tests/compare.py FOLDER [NAME ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, bool) or value is None:
            return (type(value).__name__, str(value))
        if isinstance(value, float):
            return ("float", "nan" if math.isnan(value) else repr(round(value, 6) + 0.0))
        return (type(value).__name__, str(value))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return canonical([tuple(r) for r in df.collect()], df.columns), sorted(df.columns)


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return canonical(result.fetchall(), columns), sorted(columns)


def difference(spark, con, name, query, sql, folder):
    """None if equal, else a short description."""
    got, got_columns = spark_rows(query(spark, folder))
    if sql is None:
        return None if got else "no rows"
    want, want_columns = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}: {str(only_got)[:700]} vs {str(only_want)[:700]}"
    return None if got else "no rows"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = difference(spark, con, name, queries[name], sql.get(name), folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {time.time() - start:5.1f}s {name} {problem or ''}", flush=True)
    print(f"{bad} differ of {len(names or queries)}")
