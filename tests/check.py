"""Run registered queries beside their SQL twins and report differences.

    python tests/check.py [sf] [name-substring ...]
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, q, sf_dir):
    t = time.time()
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    kinds = {c: k for c, k in df.dtypes}
    if not q.sql:
        from invariants import INVARIANTS
        if q.name not in INVARIANTS:
            return "neither an SQL twin nor an invariant", False
        wrong = INVARIANTS[q.name](spark, sf_dir, df.columns, got)
        return wrong or f"ok {len(got)} rows {spark_s:.1f}s, by its invariant", not wrong
    t = time.time()
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    duck_s = time.time() - t
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", False
    pair = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [(c, kinds[c], types[c]) for c in names if pair.get(kinds[c]) != types[c]]
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3] if len(a) < 20000 else [x for x in set(a) - set(b)][:3]
        only_b = [x for x in set(b) - set(a)][:3]
        return (f"DIFF spark {len(a)} sql {len(b)} cols {sorted(names)}\n   spark-only {str(only_a)[:1500]}\n"
                f"   sql-only {str(only_b)[:1500]}"), False
    return f"ok {len(a)} rows spark {spark_s:.1f}s sql {duck_s:.1f}s" + (f" TYPES {odd}" if odd else ""), not odd


def main():
    import duckdb
    from termflow.plans import load_all
    from termflow.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                  "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, q in load_all().items():
        if picks and not any(p in name for p in picks):
            continue
        try:
            msg, good = compare(spark, con, q, sf_dir)
        except Exception as e:
            msg, good = f"FAIL {type(e).__name__} {str(e)[:900]}", False
        if not good:
            bad.append(name)
        print(f"{name}: {msg}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
