"""Comparisons that do not depend on row order."""


def sort_key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


def rows_of(df):
    columns = sorted(df.columns)
    collected = df.select([f"`{c}`" for c in columns]).collect()
    return columns, sorted((tuple(r) for r in collected), key=sort_key)


def same(left, right):
    assert rows_of(left) == rows_of(right)


def duck_rows(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=sort_key)
