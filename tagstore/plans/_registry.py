"""The registry of queries, each with the SQL that gives the same rows."""

QUERIES, ORACLE_SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
