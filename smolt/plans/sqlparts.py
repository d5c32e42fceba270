"""Shared SQL fragments of the oracle (DuckDB dialect) mirroring the
bindings in ``smolt.sources.tables``."""

DET = "SELECT user_id AS tag, event_type AS site, ts, event_id AS tie, value FROM events"
SITES = ("SELECT * FROM (VALUES ('signup', 110.2), ('view', 110.1), ('click', 67.0), "
         "('purchase', 38.0), ('error', 23.0)) AS s(site, rkm)")
REL = ("SELECT user_id AS tag, min(ts) AS release_ts FROM events "
       "WHERE event_type = 'signup' GROUP BY user_id")
TAGS = "SELECT c_custkey AS tag, c_mktsegment AS release_group FROM customer"
OCC = ("SELECT o.o_custkey AS tag, c.c_mktsegment AS grp, "
       "CAST(year(o.o_orderdate) - 1995 AS INTEGER) AS occ, CAST(year(o.o_orderdate) AS INTEGER) AS year "
       "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")


def us(expr: str) -> str:
    """Microseconds since the epoch of a naive timestamp."""
    return f"epoch_us({expr})"


def secs(later: str, earlier: str, div: float = 1.0) -> str:
    return f"(CAST(epoch_us({later}) - epoch_us({earlier}) AS DOUBLE) / {1e6 * div!r})"
