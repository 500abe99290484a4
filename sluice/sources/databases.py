"""Database scans over JDBC, SQLite files, and the choice between the five connectors."""

from __future__ import annotations

import datetime
import hashlib
import re
from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.sources.sqlite import register_database, scan_sqlite, sqlite_tables

FETCH_ROWS = 10_000
IDENTIFIER = re.compile(r"^[a-zA-Z0-9_\.]+$")
JDBC_CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


@dataclass(frozen=True)
class Connector:
    """A JDBC database kind: catalog prefix in user SQL, URL scheme, driver, default port, table list."""

    prefix: str
    scheme: str
    driver: str
    port: int
    ssl_option: str
    tables: str
    extra: tuple[tuple[str, str], ...] = ()


_POSTGRES_TABLES = (
    "SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')"
)
_MYSQL_TABLES = "SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema = DATABASE()"

# Without a cursor this driver holds the whole result in memory, whatever the fetch size.
_MYSQL_STREAM = (("useCursorFetch", "true"),)

# Connector names, default ports, catalog prefixes.
CONNECTORS: dict[str, Connector | None] = {
    "postgresql": Connector("pg", "postgresql", "org.postgresql.Driver", 5432, "sslmode", _POSTGRES_TABLES),
    "mysql": Connector("mysql", "mysql", "com.mysql.cj.jdbc.Driver", 3306, "sslMode", _MYSQL_TABLES, _MYSQL_STREAM),
    "sqlite": None,
    "mariadb": Connector("mysql", "mariadb", "org.mariadb.jdbc.Driver", 3306, "sslMode", _MYSQL_TABLES),
    "redshift": Connector("pg", "redshift", "com.amazon.redshift.jdbc42.Driver", 5432, "sslMode", _POSTGRES_TABLES),
}


def list_connectors() -> list[str]:
    return list(CONNECTORS)


def _known(connector_type: str) -> Connector | None:
    if connector_type not in CONNECTORS:
        raise ValueError(f"no connector named {connector_type!r}, choose from {', '.join(CONNECTORS)}")
    return CONNECTORS[connector_type]


def check_identifier(name: str) -> str:
    """Table names may hold letters, digits, underscores and dots only."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def connection_options(connector_type: str, credentials: dict) -> dict[str, str]:
    """Reader options of a connection. User and password stay options and never enter the URL."""
    kind = _known(connector_type)
    if kind is None:
        path = credentials.get("database") or credentials.get("file_path")
        if not path:
            raise ValueError("sqlite credentials need a database or file_path")
        return {"path": path}
    missing = [k for k in ("host", "database", "username", "password") if credentials.get(k) is None]
    if missing:
        raise ValueError(f"{connector_type} credentials need {', '.join(missing)}")
    port = int(credentials.get("port") or kind.port)
    options = {
        "url": f"jdbc:{kind.scheme}://{credentials['host']}:{port}/{quote(credentials['database'], safe='')}",
        "driver": kind.driver,
        "user": credentials["username"],
        "password": credentials["password"],
        **dict(kind.extra),
    }
    if credentials.get("ssl_mode"):
        options[kind.ssl_option] = credentials["ssl_mode"]
    return options


def scan_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table: str | None = None,
    query: str | None = None,
    partition_column: str | list[str] | None = None,
    partition_num: int | None = None,
) -> DataFrame:
    """A table, or the result of a query that the database runs.

    With ``partition_column``, one column or several, of numbers, moments or texts, the executors read disjoint
    ranges of about as many rows side by side (``key_ranges``); without it one task streams the result.
    """
    if query is None and table is None:
        raise ValueError("a query or a table is needed")
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", FETCH_ROWS)
    target = f"({query}) q" if query is not None else table
    if partition_column is None:
        return reader.option("dbtable", target).load()
    keys = [partition_column] if isinstance(partition_column, str) else list(partition_column)
    ranges = key_ranges(spark, options, target, keys, partition_num or spark.sparkContext.defaultParallelism)
    if len(ranges) < 2:
        return reader.option("dbtable", target).load()
    return spark.read.jdbc(options["url"], target, predicates=ranges, properties={**{k: v for k, v in options.items() if k != "url"}, "fetchsize": str(FETCH_ROWS)})


SAMPLE_KEYS = 64  # sampled keys for each range: the sizes of ranges differ by an eighth or so


def key_ranges(spark: SparkSession, options: dict[str, str], target: str, keys: list[str], count: int) -> list[str]:
    """Disjoint conditions that together hold for every row and split the rows, not the values, about evenly.

    Only the keys are read: numbers and moments in equal widths side by side, others as one stream. The keys with the
    smallest hashes are a sample that tasks draw and merge; every so many of them is a border. Borders are put in order
    by the database, whose order of texts the conditions follow. Rows with one and the same key stay together; NULLs
    are in the first range.
    """
    names = [_quoted(spark, options, k) for k in keys]
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", FETCH_ROWS)
    listed = ", ".join(names)
    first = reader.option("dbtable", f"(SELECT MIN({names[0]}) AS lo, MAX({names[0]}) AS hi FROM {target}) b").load()
    low, high = first.first()
    if low is None:
        return []
    column_of = reader.option("dbtable", f"(SELECT {listed} FROM {target}) k")
    if isinstance(first.schema[0].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) and low != high:
        bounds = {"partitionColumn": names[0], "lowerBound": str(low), "upperBound": str(high), "numPartitions": count}
        column_of = column_of.options(**bounds)
    found = column_of.load()
    # NULLs and repeated keys count as rows do: the place of a row among equal ones is part of its hash.
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in found.columns]
    drawn = found.withColumn("_hash", F.xxhash64(*cells, F.monotonically_increasing_id())).orderBy("_hash").limit(count * SAMPLE_KEYS).drop("_hash")
    sampled = sorted(key for key in map(tuple, drawn.collect()) if None not in key)
    borders = sorted({sampled[len(sampled) * i // count] for i in range(1, count)}) if sampled else []
    texts = [isinstance(f.dataType, T.StringType) for f in found.schema.fields]
    if any(texts) and borders:
        asked = " OR ".join("(" + " AND ".join(f"{n} = {_literal(v, options)}" for n, v in zip(names, b)) + ")" for b in borders)
        # ORDER BY does not hold in a derived table: each border counts those before it, by the database's comparisons.
        few = f"(SELECT DISTINCT {listed} FROM {target} WHERE {asked})"
        mine = ", ".join(f"a.{n}" for n in names)
        ranks = f"(SELECT {mine}, COUNT(*) AS place FROM {few} a, {few} b WHERE {_at_least(names, names, 'a.', 'b.')} GROUP BY {mine}) r"
        borders = [tuple(r)[:-1] for r in sorted(reader.option("dbtable", ranks).load().collect(), key=lambda r: r[-1])]
    if not borders:
        return []
    above = [_at_least(names, [_literal(v, options) for v in b]) for b in borders]
    missing = " OR ".join(f"{n} IS NULL" for n in names)
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    middle = [f"({whole}) AND ({a}) AND NOT ({b})" for a, b in zip(above, above[1:])]
    return [f"({missing}) OR NOT ({above[0]})", *middle, f"({whole}) AND ({above[-1]})"]


def _at_least(names: list[str], values: list[str], left: str = "", right: str = "") -> str:
    """``names`` at or behind ``values`` in lexicographic order."""
    name, value = left + names[0], right + values[0]
    if len(names) == 1:
        return f"{name} >= {value}"
    return f"{name} > {value} OR ({name} = {value} AND ({_at_least(names[1:], values[1:], left, right)}))"


def _literal(value, options: dict[str, str]) -> str:
    if isinstance(value, str):
        text = value.replace("'", "''")
        return "'" + (text.replace("\\", "\\\\") if options["url"].startswith(("jdbc:mysql", "jdbc:mariadb")) else text) + "'"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"'{value}'"
    return str(value)


def _quoted(spark: SparkSession, options: dict[str, str], column: str) -> str:
    check_identifier(column)
    mark = "`" if options["url"].startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
    return f"{mark}{column}{mark}"


def jdbc_tables(spark: SparkSession, options: dict[str, str], catalog_query: str) -> DataFrame:
    """The tables of a database, from its own catalog view."""
    return scan_jdbc(spark, options, query=catalog_query)


def source_tables(spark: SparkSession, connector_type: str, credentials: dict) -> DataFrame:
    """The tables of a source."""
    kind, options = _known(connector_type), connection_options(connector_type, credentials)
    return sqlite_tables(spark, options["path"]) if kind is None else jdbc_tables(spark, options, kind.tables)


def test_connection(spark: SparkSession, connector_type: str, credentials: dict) -> dict:
    """Whether the source answers, and how many tables it has."""
    try:
        count = source_tables(spark, connector_type, credentials).agg(F.count("*")).first()[0]
    except ValueError:
        raise
    except Exception as error:  # drivers raise their own classes
        return {"success": False, "error": "connection_failed", "message": str(error).splitlines()[0]}
    return {"success": True, "message": "Connection successful", "metadata": {"database_type": connector_type, "table_count": count}}


test_connection.__test__ = False  # not a test, for pytest


def extract_table(spark: SparkSession, connector_type: str, credentials: dict, table_name: str, **partitioning) -> DataFrame:
    """A whole table, in ranges of its primary key unless ``partition_column`` names another column."""
    check_identifier(table_name)
    options = connection_options(connector_type, credentials)
    if _known(connector_type) is None:
        return scan_sqlite(spark, options["path"], table_name)
    if not partitioning.get("partition_column"):
        partitioning["partition_column"] = range_key(spark, options, table_name)
    return scan_jdbc(spark, options, table=table_name, **partitioning)


def range_key(spark: SparkSession, options: dict[str, str], table_name: str) -> str | list[str] | None:
    """The primary key of a table, one column or several, if ranges can split it, from the standard catalog views."""
    *schema, table = check_identifier(table_name).split(".")
    query = (
        "SELECT k.column_name AS column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k"
        " ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name"
        f" WHERE c.constraint_type = 'PRIMARY KEY' AND lower(c.table_name) = lower('{table}')"
    )
    if schema:
        query += f" AND lower(c.table_schema) = lower('{schema[-1]}')"
    try:
        keys = [row[0] for row in scan_jdbc(spark, options, query=query).limit(10).collect()]
    except (PySparkException, Py4JJavaError) as error:
        # No such views, or no right to read them; anything else (the network, the password) is the caller's to know.
        if not re.search(r"SQLSyntaxErrorException|does not exist|doesn't exist|permission|privilege|denied", str(error), re.I):
            raise
        return None
    if not keys or not all(IDENTIFIER.fullmatch(k) for k in keys):
        return None
    kinds = {f.name: f.dataType for f in scan_jdbc(spark, options, table=table_name).schema}
    if not all(isinstance(kinds.get(k), (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)) for k in keys):
        return None
    return keys[0] if len(keys) == 1 else keys


def extract_query(spark: SparkSession, connector_type: str, credentials: dict, query: str, pushdown: bool | None = None, **partitioning) -> DataFrame:
    """Any SELECT: run by the database, or by Spark over its tables under the prefix (pg, mysql, sqlite).

    By default a text that names tables under the prefix is run by Spark, any other by the database.
    """
    options = connection_options(connector_type, credentials)
    kind = _known(connector_type)
    if kind is None:
        register_database(spark, options["path"])
        return spark.sql(query)
    if pushdown if pushdown is not None else not names_prefix(query, kind.prefix):
        return scan_jdbc(spark, options, query=query, **partitioning)
    return query_catalog(spark, kind.prefix, options, query)


def names_prefix(query: str, prefix: str) -> bool:
    """Whether a text reads from tables under the prefix; quoted text and comments do not count."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", query, flags=re.S)
    return re.search(rf"\b(?:from|join)\s+[`\"]?{prefix}[`\"]?\s*\.", bare, re.I) is not None


_sessions: dict[tuple[int, str], SparkSession] = {}


def query_catalog(spark: SparkSession, prefix: str, options: dict[str, str], query: str) -> DataFrame:
    """A SELECT over the tables of one database, named under the prefix; filters and aggregates are pushed down.

    Each connection has a session of its own, whose catalog the prefix is: two databases of one kind never stand in for
    each other, results of both can be joined, and no credentials stay in the caller's settings.
    """
    key = id(spark._jsparkSession), hashlib.sha256(repr((prefix, sorted(options.items()))).encode()).hexdigest()
    if key not in _sessions:
        own = _beside(spark)
        register_catalog(own, prefix, options)
        _sessions[key] = own
    return _sessions[key].sql(query)


def _beside(spark: SparkSession) -> SparkSession:
    """A session with the same settings and catalogs and views of its own."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def register_catalog(spark: SparkSession, prefix: str, options: dict[str, str]) -> None:
    """The database as a Spark catalog: ``prefix.schema.table`` in SQL, filters and aggregates pushed down.

    A session loads a catalog once; use ``query_catalog`` where several databases share a prefix.
    """
    key = f"spark.sql.catalog.{prefix}"
    for name, value in options.items():
        spark.conf.set(f"{key}.{name}", value)
    spark.conf.set(key, JDBC_CATALOG)


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Any SELECT over the given tables; views of these names that the caller has made come back afterwards."""
    held = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in map(check_identifier, tables) if name.lower() in held}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query)  # resolved here: the result does not look the names up again
    finally:
        for name in tables:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)

