"""Small inline tables, the same rows for Spark and as SQL text."""

from __future__ import annotations

#: Spark types and what SQL calls them.
TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "binary": "BLOB", "double": "DOUBLE"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, bytes):
        return "from_hex('" + value.hex() + "')"
    if isinstance(value, str):
        parts = value.split("\0")
        return " || chr(0) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
    return repr(value)


class Inline:
    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.split() for c in schema.split(", ")]

    def df(self, spark):
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(f"CAST(c{i} AS {TYPES[t]}) AS {n}" for i, (n, t) in enumerate(self.columns))
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT {names} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(len(self.columns)))}))"
