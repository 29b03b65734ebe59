"""Compare a Spark result with the rows DuckDB gives for its SQL twin."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: [(v is not None, str(type(v)), v) for v in row],
    )


# Names of one type in either system.
_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def differences(spark_df, con, sql):
    """What differs: column names, types, or rows.  Empty if nothing does."""
    described = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    ours = dict(spark_df.dtypes)
    found = []
    if sorted(described) != sorted(ours):
        return [f"columns {sorted(ours)} are not {sorted(described)}"]
    for name, dtype in described.items():
        if _TYPES.get(dtype, dtype) != ours[name]:
            found.append(f"{name} is {ours[name]}, not {dtype}")
    cursor = con.execute(sql)
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    mine = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows, not {len(theirs)}")
    elif mine != theirs:
        wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
