"""For each registered query the same result in plain SQL over the given tables."""

_ATTEMPTS = """a AS (SELECT *, CAST(1 + coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS version FROM events)"""

_HOLES = """d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS price,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS prio FROM orders)"""

_MIXED = """d AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS mixed FROM part)"""


def _wide_profile(table: str, kinds: dict[str, str], order: str) -> str:
    """One row per column of a table."""
    rows = []
    for name, kind in kinds.items():
        number = kind not in ("VARCHAR", "TIMESTAMP")
        ends = [f"CAST({f}({name}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)" for f in ("min", "max")]
        texts = [f"CAST({f}({name}) AS VARCHAR)" if kind == "TIMESTAMP" else "CAST(NULL AS VARCHAR)" for f in ("min", "max")]
        first = f"CAST(first({name} ORDER BY {order}) AS VARCHAR)"
        rows.append(
            f"SELECT '{name}' AS name, '{kind}' AS inferred_type, count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_count,"
            f" {ends[0]} AS min_value, {ends[1]} AS max_value, {texts[0]} AS min_text, {texts[1]} AS max_text, {first} AS first_value FROM {table}"
        )
    return " UNION ALL ".join(rows)


_LINEITEM = {
    "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INTEGER", "l_quantity": "DOUBLE",
    "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_returnflag": "VARCHAR", "l_linestatus": "VARCHAR",
    "l_shipdate": "TIMESTAMP",
}
_ORDERS = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP",
    "o_orderpriority": "VARCHAR",
}


ORACLE_SQL: dict[str, str] = {
    "scan_csv": "SELECT * FROM orders",
    "scan_tsv": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_delimited": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "scan_csv_quoted": "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
    "scan_csv_breaks": "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
    "scan_csv_mixed_headers": """SELECT doc_id, nullif(text, '') AS text, CASE WHEN doc_id % 2 = 1 THEN lang END AS lang,
        CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents""",
    "scan_csv_folders": "SELECT * FROM orders",
    "scan_csv_headerless_detected": """SELECT l_orderkey AS column0, l_partkey AS column1, l_suppkey AS column2, CAST(l_linenumber AS BIGINT) AS column3,
        l_quantity AS column4, l_extendedprice AS column5, l_discount AS column6, l_tax AS column7, l_returnflag AS column8,
        l_linestatus AS column9, l_shipdate AS column10 FROM lineitem""",
    "scan_csv_dialects": """SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 1 THEN '; ' WHEN 2 THEN '| ' ELSE ', ' END || p_brand AS p_name, p_brand, p_type,
        CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""",
    "convert_quarantine": """SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 11 = 5 THEN 'more cells than the header' END,
        CASE WHEN o_orderkey % 50 = 7 THEN 'o_totalprice: not DOUBLE' END) AS reason, o_orderkey % 50 = 7 AS dropped
        FROM orders WHERE o_orderkey % 11 = 5 OR o_orderkey % 50 = 7""",
    "skip_rows_many": """SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS rn FROM lineitem)
        WHERE rn % 3 = 1 OR rn >= 1000000""",
    "sample_uniform": "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 1000",
    "join_asof": """SELECT event_id, user_id, ts, event_type, bought_id, bought_value FROM (
        SELECT e.event_id, e.user_id, e.ts, e.event_type, p.event_id AS bought_id, p.value AS bought_value,
          row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS rn
        FROM events e LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) WHERE rn = 1""",
    "join_interval": """SELECT r.l_orderkey AS r_orderkey, r.l_linenumber AS r_linenumber, r.l_partkey AS r_partkey, r.l_suppkey, count(*) AS n,
        sum(s.l_quantity) AS quantity FROM lineitem r JOIN lineitem s ON r.l_suppkey = s.l_suppkey
        AND s.l_shipdate BETWEEN r.l_shipdate - INTERVAL 7 DAY AND r.l_shipdate + INTERVAL 7 DAY
        WHERE r.l_returnflag = 'R' GROUP BY ALL""",
    "scan_jdbc_skewed": """SELECT o_orderkey, o_orderstatus, o_totalprice,
        CASE WHEN o_orderkey % 500 = 3 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_orderkey * 1000 ELSE o_orderkey END AS far FROM orders""",
    "extract_query_two_databases": """SELECT o_orderkey, o_totalprice, -o_totalprice + 200000 AS rest FROM orders
        WHERE o_totalprice > 1000 AND -o_totalprice + 200000 > 1000""",
    "stream_windows": """WITH ends AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
        placed AS (SELECT e.*, least(5, CAST(floor((epoch_us(ts) - lo) * 6 / (hi - lo + 1)) AS INTEGER) + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS arrival,
          time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS since FROM events e, ends),
        seen AS (SELECT arrival, max(ts) AS latest FROM placed GROUP BY arrival),
        marks AS (SELECT a.arrival, max(s.latest) - INTERVAL 6 HOUR AS mark FROM (SELECT DISTINCT arrival FROM placed) a LEFT JOIN seen s ON s.arrival < a.arrival - CASE WHEN a.arrival = 4 THEN 0 ELSE 1 END GROUP BY a.arrival)
        SELECT since, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM placed p JOIN marks m ON p.arrival = m.arrival
        WHERE mark IS NULL OR since + INTERVAL 6 HOUR > mark GROUP BY since, event_type""",
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_json": "SELECT * FROM events",
    "scan_json_mixed": "SELECT * FROM events",
    "scan_json_concatenated": "SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents",
    "scan_json_array": "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem",
    "scan_json_nested": """SELECT o_orderkey, o_totalprice AS total, o_custkey AS custkey, CAST(day(o_orderdate) AS INTEGER) AS day,
        date_trunc('second', o_orderdate) AS moment FROM orders""",
    "scan_geojson": "SELECT 'FeatureCollection' AS type, 2 AS feature_count, c_acctbal AS x, c_custkey FROM customer",
    "scan_excel": "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "csv_null_padding": """SELECT o_orderkey, o_orderstatus,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""",
    "csv_long_rows": """SELECT CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',extra' AS "row" FROM orders WHERE o_orderkey % 11 = 5""",
    "csv_ignore_errors": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 <> 7",
    "sniff_types": """SELECT * FROM (VALUES ('o_orderkey', 'BIGINT'), ('o_orderstatus', 'VARCHAR'), ('o_totalprice', 'DOUBLE'),
        ('o_orderdate', 'TIMESTAMP')) t(name, inferred_type)""",
    "scan_sqlite": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "source_tables": "SELECT 'supplier' AS table_name",
    "scan_jdbc": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "scan_jdbc_partitioned": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "extract_table": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "extract_query_database": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "extract_query_prefix": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0",
    "column_mapping": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice FROM orders",
    "type_overrides": """SELECT o_orderkey, TRY_CAST(o_totalprice AS INTEGER) AS o_totalprice, TRY_CAST(o_orderdate AS DATE) AS o_orderdate,
        TRY_CAST(split_part(o_orderpriority, '-', 2) AS INTEGER) AS o_orderpriority FROM orders""",
    "type_overrides_text": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(l_extendedprice AS VARCHAR) AS l_extendedprice,
        TRY_CAST(l_tax AS DECIMAL(10,1)) AS l_tax, TRY_CAST(l_shipdate AS VARCHAR) AS l_shipdate,
        TRY_CAST(CAST(l_quantity AS VARCHAR) AS SMALLINT) AS l_quantity FROM lineitem""",
    "rename_and_cast": """SELECT o_orderkey AS id, TRY_CAST(o_totalprice AS BIGINT) AS amount, TRY_CAST(o_custkey AS VARCHAR) AS cust
        FROM orders""",
    "skip_rows": """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
        WHERE rn NOT IN (0, 1, 7, 100)""",
    "skip_rows_file": """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
        WHERE rn NOT IN (0, 1, 7, 100)""",
    "skip_rows_count": """SELECT CAST(count(*) AS BIGINT) AS rows_removed
        FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn IN (0, 1, 7, 100, 999999999)""",
    "describe_columns": """SELECT 1 AS position, 'c_custkey' AS name, 'BIGINT' AS type, 'numeric' AS class, count(c_custkey) AS value_count FROM customer
        UNION ALL SELECT 2, 'c_name', 'VARCHAR', 'text', count(c_name) FROM customer
        UNION ALL SELECT 3, 'c_nationkey', 'INTEGER', 'numeric', count(c_nationkey) FROM customer
        UNION ALL SELECT 4, 'c_acctbal', 'DOUBLE', 'numeric', count(c_acctbal) FROM customer
        UNION ALL SELECT 5, 'c_mktsegment', 'VARCHAR', 'text', count(c_mktsegment) FROM customer""",
    "sink_parquet": "SELECT * FROM lineitem",
    "sink_compression": "SELECT codec, n FROM (VALUES ('zstd'), ('snappy'), ('none')) c(codec) CROSS JOIN (SELECT count(*) AS n FROM orders)",
    "versioned_output": "SELECT * FROM supplier",
    "output_summary": "SELECT count(*) AS row_count, 5 AS column_count FROM customer",
    "sample_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
    "head_sample": "SELECT * FROM customer ORDER BY c_custkey LIMIT 100",
    "profile_totals": "SELECT count(*) AS total_rows, 6 AS total_columns FROM orders",
    "profile_nulls": f"""WITH {_HOLES}
        SELECT 'o_orderkey' AS name, count(*) - count(o_orderkey) AS null_count, count(*) - count(o_orderkey) > 0 AS nullable FROM d
        UNION ALL SELECT 'price', count(*) - count(price), count(*) - count(price) > 0 FROM d
        UNION ALL SELECT 'prio', count(*) - count(prio), count(*) - count(prio) > 0 FROM d""",
    "profile_distinct": """SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS unique_count FROM orders
        UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
    "profile_sample_values": f"""WITH {_HOLES}
        SELECT 'price' AS name, CAST(rn AS INTEGER) AS position, CAST(price AS VARCHAR) AS sample_value
        FROM (SELECT price, row_number() OVER (ORDER BY o_orderkey) AS rn FROM d WHERE price IS NOT NULL) WHERE rn <= 5""",
    "profile_minmax_numeric": """SELECT 'l_quantity' AS name, CAST(min(l_quantity) AS DOUBLE) AS min_value, CAST(max(l_quantity) AS DOUBLE) AS max_value FROM lineitem
        UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', CAST(min(l_extendedprice) AS DOUBLE), CAST(max(l_extendedprice) AS DOUBLE) FROM lineitem""",
    "profile_minmax_temporal": """SELECT 'l_shipdate' AS name, CAST(min(l_shipdate) AS VARCHAR) AS min_value, CAST(max(l_shipdate) AS VARCHAR) AS max_value FROM lineitem
        UNION ALL SELECT 'ts', CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM events""",
    "detect_string_format": r"""WITH v AS (SELECT 'mail' AS name, replace(c_name, '#', '.') || '@example.com' AS x FROM customer
        UNION ALL SELECT 'url', url FROM pages
        UNION ALL SELECT 'tel', '+41 44 ' || CAST(1000000 + c_custkey AS VARCHAR) FROM customer
        UNION ALL SELECT 'uid', substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-'
            || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) FROM customer
        UNION ALL SELECT 'none', c_mktsegment FROM customer),
        s AS (SELECT name,
            avg(CASE WHEN regexp_matches(x, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 1.0 ELSE 0.0 END) AS e,
            avg(CASE WHEN regexp_matches(x, '^https?://') THEN 1.0 ELSE 0.0 END) AS u,
            avg(CASE WHEN regexp_matches(x, '^\+?[\d\s\-\(\)]{10,}$') THEN 1.0 ELSE 0.0 END) AS p,
            avg(CASE WHEN regexp_matches(lower(x), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 1.0 ELSE 0.0 END) AS g
            FROM v GROUP BY name)
        SELECT name, CASE WHEN e > 0.8 THEN 'email' WHEN u > 0.8 THEN 'url' WHEN p > 0.8 THEN 'phone' WHEN g > 0.8 THEN 'uuid' END AS detected_format
        FROM s""",
    "warn_high_null": f"""WITH {_HOLES},
        n AS (SELECT 'price' AS name, count(*) - count(price) AS nulls, count(*) AS total FROM d
            UNION ALL SELECT 'prio', count(*) - count(prio), count(*) FROM d)
        SELECT name AS column_name, 'high_null_percentage' AS issue, 'Column has ' || printf('%.1f', nulls / total * 100) || '% null values' AS message
        FROM n WHERE total > 0 AND nulls / total * 100 > 50""",
    "warn_type_inconsistency": rf"""WITH {_MIXED},
        r AS (SELECT mixed, row_number() OVER (ORDER BY p_partkey) AS rn, regexp_matches(mixed, '^-?\d+\.?\d*$') AS num FROM d WHERE mixed IS NOT NULL)
        SELECT 'mixed' AS column_name, 'type_inconsistency' AS issue, rn AS affected_row FROM r
        WHERE rn <= 100 AND NOT num AND (SELECT avg(CASE WHEN num THEN 1.0 ELSE 0.0 END) FROM r WHERE rn <= 20) > 0.5 ORDER BY rn LIMIT 10""",
    "numeric_text_shares": rf"""WITH {_MIXED}
        SELECT 'mixed' AS column_name, round(avg(CASE WHEN regexp_matches(mixed, '^-?\d+\.?\d*$') THEN 1.0 ELSE 0.0 END), 6) AS numeric_share,
            count(*) FILTER (WHERE NOT regexp_matches(mixed, '^-?\d+\.?\d*$')) AS other_count FROM d WHERE mixed IS NOT NULL""",
    "profile_columns": """SELECT 'c_custkey' AS name, 'BIGINT' AS inferred_type, count(*) - count(c_custkey) AS null_count, count(DISTINCT c_custkey) AS unique_count,
            CAST(min(c_custkey) AS DOUBLE) AS min_value, CAST(max(c_custkey) AS DOUBLE) AS max_value FROM customer
        UNION ALL SELECT 'c_acctbal', 'DOUBLE', count(*) - count(c_acctbal), count(DISTINCT c_acctbal), min(c_acctbal), max(c_acctbal) FROM customer
        UNION ALL SELECT 'c_mktsegment', 'VARCHAR', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL FROM customer""",
    "profile_wide": _wide_profile("lineitem", _LINEITEM, "l_orderkey, l_linenumber, l_partkey, l_suppkey"),
    "profile_incremental": _wide_profile("orders", _ORDERS, "o_orderkey % 4 = 3, o_orderkey"),
    "convert_file": """SELECT o_orderkey AS order_id, TRY_CAST(o_custkey AS VARCHAR) AS o_custkey, TRY_CAST(o_totalprice AS BIGINT) AS o_totalprice,
        CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
    "convert_database": "SELECT * FROM orders",
    "extract_query_filter": "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'",
    "extract_query_predicate": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0",
    "extract_query_join": """SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""",
    "extract_query_semi_anti": """SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS has_orders FROM customer c""",
    "extract_query_group": """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY o_orderstatus""",
    "extract_query_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extract_query_window": """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
        FROM orders""",
    "extract_query_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "extract_query_setops": """(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
        EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""",
    "extract_query_scalar": """SELECT o_orderkey, upper(o_orderpriority) AS prio, CAST(year(o_orderdate) AS INTEGER) AS y,
        round(o_totalprice / 100, 1) AS hundreds FROM orders""",
    "extract_query_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "ledger_assign_versions": f"""WITH {_ATTEMPTS}
        SELECT event_id, user_id AS source_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'active' END AS status, version FROM a""",
    "ledger_latest_status": f"""WITH {_ATTEMPTS},
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, version ORDER BY ts DESC, event_id DESC) AS k FROM a)
        SELECT user_id AS source_id, version, CASE WHEN event_type = 'error' THEN 'error' ELSE 'active' END AS status FROM r WHERE k = 1""",
    "ledger_version_records": f"""WITH {_ATTEMPTS},
        r AS (SELECT a.event_id, a.user_id AS source_id, a.version, CASE WHEN a.event_type = 'error' THEN 'error' ELSE 'active' END AS status,
            CAST(nullif(floor(e.value), 0) AS BIGINT) AS file_size_bytes, CASE WHEN a.event_type = 'error' THEN e.props END AS error_message
            FROM a JOIN events e USING (event_id))
        SELECT * FROM r""",
    "ledger_current_version": """SELECT user_id AS source_id, count(*) FILTER (WHERE event_type <> 'error') AS current_version
        FROM events GROUP BY user_id""",
    "ledger_metrics": """SELECT source_id, row_count, file_size_bytes FROM (SELECT user_id AS source_id, event_id AS row_count,
            CAST(nullif(floor(value), 0) AS BIGINT) AS file_size_bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
        FROM events WHERE event_type <> 'error') WHERE k = 1""",
    "ledger_last_query": """SELECT source_id, extraction_query FROM (SELECT user_id AS source_id, props AS extraction_query,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
        FROM events WHERE event_type <> 'error' AND props IS NOT NULL AND props <> '') WHERE k = 1""",
    "ledger_source_lookup": """SELECT o_orderkey AS request_id, o_custkey AS source_id, c_name, c_mktsegment AS connector_type,
        c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
}
