"""Runs registered queries on Spark and their SQL on DuckDB and compares all rows."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, con, query, folder: str) -> str | None:
    """None if equal, else what differs."""
    df = query.run(spark, folder)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    if wrong:
        cells = [(sorted(names)[i], x, y) for i, (x, y) in enumerate(zip(*wrong[0])) if not same(x, y)]
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0][0][:4]}: {cells[:4]}"
    return None


def main(folder: str, only: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    from skyledger.registry import QUERIES
    from tests.conftest import make_session

    spark, con = make_session(), duck(folder)
    for name, query in QUERIES.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            if query.sql is None:
                verdict = f"rows only: {query.run(spark, folder).count()}"
            else:
                verdict = compare(spark, con, query, folder) or "ok"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
