from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import persist_to_shared, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Widen integers and round doubles, so both engines print the same values."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            col = F.round(col.cast("double"), 6)
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB text when the result is SQL-expressible."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(prepare(spark), sf_dir.rstrip("/")))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_staged: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries read: written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = persist_to_shared(build(), name)
    return _staged[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCHEMA = """
CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT);
CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER);
CREATE TABLE benchmark (item_id BIGINT, text VARCHAR);
CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER);
CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR);
CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR);
"""


def portable_sql(statements: dict[str, str]) -> dict[str, str]:
    """The same widening and rounding as :func:`portable`, wrapped around each SQL text."""
    import duckdb

    con = duckdb.connect()
    con.execute(SCHEMA)
    out = {}
    for name, sql in statements.items():
        columns = []
        try:
            described = con.execute(f"DESCRIBE {sql}").fetchall()
        except duckdb.Error as exc:
            raise ValueError(f"SQL of {name}: {exc}") from exc
        for column, kind, *_ in described:
            kind = kind.upper()
            if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
                columns.append(f'round("{column}"::DOUBLE, 6) AS "{column}"')
            elif kind in ("INTEGER", "SMALLINT", "TINYINT", "HUGEINT", "UINTEGER", "UBIGINT", "BIGINT"):
                columns.append(f'"{column}"::BIGINT AS "{column}"')
            else:
                columns.append(f'"{column}"')
        out[name] = f"SELECT {', '.join(columns)} FROM ({sql}) AS answer"
    con.close()
    return out
