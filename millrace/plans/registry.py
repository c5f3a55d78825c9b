"""Named queries and the SQL that must give the same rows."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    """Register ``fn(spark, folder) -> DataFrame`` with its SQL, where SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
