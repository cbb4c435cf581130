"""Registered queries, the SQL that states them for DuckDB, and literal text both engines can build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilgrid.functions.patterns import re2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where there is one, its SQL."""

    def add(f: Query) -> Query:
        assert name not in QUERIES
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for work that is heavy by row; a large one as its files are split.

    Only where there are less than 16 MB a core, which bounds what is moved; a file of one row group is one task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def lit(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A DuckDB literal of a pattern in RE2's dialect."""
    return lit(re2(pattern))


def names(values: tuple[str, ...]) -> str:
    return ", ".join(map(lit, values))


def case(expr: str, table_: dict[str, float | str], default: float | str) -> str:
    show = lambda v: lit(v) if isinstance(v, str) else repr(v)
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {show(v)}" for k, v in table_.items()) + f" ELSE {show(default)} END"


def first_matches(source: str, patterns: tuple[str, ...], valid: str = "TRUE", key: str = "v", keys: str = "id", text: str = "text") -> str:
    """SQL of ``(keys, v, p, i)``: matches of several patterns, the first of equal key of a row."""
    lists = " UNION ALL ".join(f"SELECT {keys}, {k} AS p, regexp_extract_all({text}, {rx(x)}, 0) AS l FROM ({source})" for k, x in enumerate(patterns))
    flat = f"SELECT {keys}, p, unnest(l) AS v, unnest(range(len(l))) AS i FROM ({lists})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys}, {key} ORDER BY p, i) AS rn FROM ({flat}) WHERE {valid}"
    return f"SELECT {keys}, v, p, i FROM ({ranked}) WHERE rn = 1"


# A text for each customer, in SQL that both engines read: one line of each kind of data, with numbers from the key.
_PAD = "lpad(CAST({} AS STRING), {}, '0')"
_K = "c_custkey"


def _digits(n: int, times: int = 1, plus: int = 0) -> str:
    return _PAD.format(f"({_K} * {times} + {plus}) % {10**n}", n)


_HASH = f"md5(CAST({_K} AS STRING))"
_KINDS = (
    f"'ref ' || {_digits(3, 7, 101)} || '-' || {_digits(2, 3, 11)} || '-' || {_digits(4, 13, 1000)}",
    f"'Write to user' || CAST({_K} AS STRING) || '@' || CASE WHEN {_K} % 3 = 0 THEN 'github.com' WHEN {_K} % 3 = 1 THEN 'example.com' ELSE 'postbox.net' END || ' or admin@postbox.net'",
    f"'Call (' || {_digits(3, 11, 200)} || ') ' || {_digits(3, 5, 200)} || '-' || {_digits(4, 17, 2000)} || ' or +44 20 ' || {_digits(4, 3, 7000)} || ' ' || {_digits(4, 7, 1000)}",
    f"CASE WHEN {_K} % 3 = 0 THEN 'Card 4111 1111 1111 1111 ok' ELSE 'Card 4111-1111-1111-' || {_digits(4, 31, 0)} END",
    f"'api_key = \"' || CASE WHEN {_K} % 3 = 0 THEN 'sk_live_' ELSE 'zz' END || {_HASH} || '\"'",
    f"'use ghp_' || substr({_HASH}, 1, 24) || ' and pk' || substr({_HASH}, 1, 20) || ' here'",
    f"'Authorization: Bearer ' || {_HASH} || '.x'",
    f"'jwt eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3' || CAST({_K} AS STRING) || 'X.' || {_HASH}",
    f"'Patient MRN-' || {_digits(8, 97, 10000000)} || ' chart ABC' || {_digits(7, 3, 1000000)}",
    f"'Account number: ' || {_digits(10, 1234567, 1000000000)} || ' routing ' || {_digits(9, 7654321, 100000000)}",
    f"CAST({_K} % 900 + 1 AS STRING) || ' Oak St, Springfield ' || {_digits(5, 7, 10000)} || '; no number'",
    f"CASE WHEN {_K} % 3 = 0 THEN '$1,250.00' WHEN {_K} % 3 = 1 THEN '250,000.00 USD' ELSE '$12,' || {_digits(3, 7, 0)} END",
    f"CASE WHEN {_K} % 3 = 0 THEN '01/15/19' || {_digits(2, 7, 0)} ELSE 'March 3, 20' || {_digits(2, 3, 0)} END",
    f"'user_' || CAST({_K} AS STRING)",
    f"'PAN ABCDE' || {_digits(4, 3, 1000)} || 'F and K' || {_digits(7, 11, 1000000)} || '.'",
    "'Nothing sensitive here, just a sunny afternoon. Second sentence! Third?'",
    f"{_digits(4, 3, 1000)} || ' ' || {_digits(4, 5, 2000)} || ' ' || {_digits(4, 7, 3000)}",
    f"'session token_' || {_HASH} || ' kept secret'",
    f"'slack xoxb-' || substr({_HASH}, 1, 20) || ' password: hunter' || CAST({_K} AS STRING)",
    f"'P.O. Box ' || CAST({_K} AS STRING) || '|Box in ' || {_digits(5, 9, 10000)} || '-1234 somewhere'",
)
SYNTH_TEXT = f"CASE c_custkey % {len(_KINDS)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS)) + " END"
SYNTH_SQL = f"SELECT c_custkey AS id, {SYNTH_TEXT} AS text FROM customer"


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same relation in Spark."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{SYNTH_TEXT} AS text")
