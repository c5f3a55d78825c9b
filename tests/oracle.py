"""Runs a query in Spark and its SQL in DuckDB and compares them as sets of rows."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: [(v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row])


# Spark's type names beside DuckDB's
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, folder, fn, sql):
    """List of differences, empty when the results agree."""
    result = fn(spark, folder)
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} against {sorted(names)}"]
    ours = rows_of(result.columns, result.collect())
    theirs = rows_of(names, theirs)
    problems = []
    kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    for field in result.schema:
        expected = TYPES.get(field.dataType.simpleString())
        if expected != kinds[field.name]:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} against {len(theirs)}")
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        problems.append(f"{len(different)} different rows, first {different[0]}")
    return problems


if __name__ == "__main__":
    import sys
    import tempfile
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from millrace.plans import ORACLE, QUERIES
    from millrace.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        # a session that knows nothing of the library, in a time zone far from UTC
        from pyspark.sql import SparkSession

        session = (
            SparkSession.builder.master("local[8]")
            .config("spark.sql.session.timeZone", "America/New_York")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-"))
            .getOrCreate()
        )
    else:
        session = build_session("local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-")})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problems = compare(session, con, folder, fn, ORACLE[name])
            else:
                problems = [f"no SQL, {fn(session, folder).count()} rows"]
        except Exception as exc:
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        print(f"{name}: {time.time() - start:.1f}s", "; ".join(problems) or "ok", flush=True)
