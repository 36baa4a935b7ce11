"""Compares a Spark result with SQL's, whatever their order."""


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def assert_same(df, duck, sql):
    columns, got = rows(df)
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
