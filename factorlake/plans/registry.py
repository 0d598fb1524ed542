"""Query registry: a Spark callable and, where SQL can say it, its DuckDB counterpart."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def out(expr: str, alias: str, digits: int = 6) -> str:
    """Rounded SQL output column without negative zeros, NaN as NULL."""
    x = f"CAST(({expr}) AS DOUBLE)"
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE round({x}, {digits}) + 0.0 END AS {alias}"
