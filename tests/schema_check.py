"""Compare Spark result types with DuckDB result types for every oracle.

Usage: python tests/schema_check.py [sf_dir]. Builds each query (no action)
and DESCRIBEs its SQL; prints the columns whose type families differ."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from narrata.session import local_session
    from tests.oracle_check import duck
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, sql in sqls.items():
        if name in ("metrics_store", "comparison_csv", "vocab_roundtrip", "read_split",
                    "csv_scan", "triage_stream"):
            # these write first; their schema is checked after the write
            pass
        df = qs[name](spark, sf_dir)
        st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        diffs = [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt))
                 if SPARK_TO_DUCK.get(st.get(c), st.get(c)) != dt.get(c)]
        if diffs:
            bad += 1
            print(name, diffs)
    print("queries with type differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
