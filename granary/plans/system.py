"""Registered queries over the system catalog of the tables in a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.catalog import Catalog, ColumnDef, ConstraintDef, IndexDef, TableDef, ViewDef
from granary.functions.scalars import session_values
from granary.operators import statistics
from granary.plans.registry import register, table
from granary.sources.system_catalog import SystemCatalog

_NAMES = {"int": "integer", "timestamp_ntz": "timestamp", "timestamp": "timestamp", "float": "real", "array<float>": "real[]", "array<double>": "double[]", "array<string>": "text[]"}
#: All tables of a folder, with their keys.
_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",),
    "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
_SQL_TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double precision' WHEN 'TIMESTAMP' THEN 'timestamp without time zone' WHEN 'FLOAT[]' THEN 'ARRAY' ELSE lower(data_type) END"
_LIST = ", ".join(f"'{t}'" for t in _KEYS)


def _oid(kind: str, name: str) -> str:
    """SQL of the object id: FNV-1a of kind:name (an SQL expression), modulo 10 ** 9, plus 10000."""
    text = f"('{kind}:' || {name})"
    step = "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
    codes = f"list_transform(range(1, length({text}) + 1), lambda place: ascii(substr({text}, place, 1))::HUGEINT)"
    return f"CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, {codes}), {step}) % 1000000000 + 10000 AS BIGINT)"


def described(spark: SparkSession, folder: str) -> SystemCatalog:
    """A catalog, in memory, of all tables of the folder with their keys, an index and a view."""
    catalog = Catalog(spark, None)
    for name, keys in _KEYS.items():
        fields = table(spark, folder, name).schema.fields
        columns = tuple(ColumnDef(f.name, _NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()), f.name not in keys, f.name in keys) for f in fields)
        rules = (ConstraintDef("nation_region_fkey", "foreign_key", ("n_regionkey",), None, ("region", "r_regionkey")),) if name == "nation" else ()
        catalog.create_table(1, TableDef(name, columns, rules))
    catalog.tenant(1).indexes["orders_by_customer"] = IndexDef("orders_by_customer", "orders", ("o_custkey",))
    catalog.create_view(1, ViewDef("rich_customers", "SELECT * FROM customer WHERE c_acctbal > 5000"))
    return SystemCatalog(catalog, 1, lambda name: table(spark, folder, name))


def _system(name: str, relation: str, sql: str | None = None, *columns: str, where: str | None = None) -> None:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        found = described(spark, folder).relation(relation, () if where else columns)
        found = found.where(where) if where else found
        return found.select(*columns) if columns else found

    register(name, sql)(make)


_system("sys_tables", "information_schema.tables", f"SELECT 'public' AS table_schema, table_name, 'BASE TABLE' AS table_type FROM information_schema.tables WHERE table_name IN ({_LIST}) UNION ALL SELECT 'public', 'rich_customers', 'VIEW'", "table_schema", "table_name", "table_type")
_system("sys_columns", "information_schema.columns", f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, {_SQL_TYPES} AS data_type FROM information_schema.columns WHERE table_name IN ({_LIST})", "table_name", "column_name", "ordinal_position", "data_type")
_system("sys_pg_tables", "pg_tables", f"SELECT 'public' AS schemaname, table_name AS tablename, true AS hasindexes FROM information_schema.tables WHERE table_name IN ({_LIST})", "schemaname", "tablename", "hasindexes")
_system("sys_pg_columns", "pg_columns", f"SELECT table_name AS tablename, column_name AS columnname, CAST(ordinal_position AS INTEGER) AS ordinal, {_SQL_TYPES} AS datatype FROM information_schema.columns WHERE table_name IN ({_LIST})", "tablename", "columnname", "ordinal", "datatype")
_system("sys_pg_indexes", "pg_indexes", f"SELECT table_name AS tablename, table_name || '_pkey' AS indexname, true AS isunique FROM information_schema.tables WHERE table_name IN ({_LIST}) UNION ALL SELECT 'orders', 'orders_by_customer', false", "tablename", "indexname", "isunique")
_INDEXES = f"(SELECT table_name AS t, table_name || '_pkey' AS i, true AS u FROM information_schema.tables WHERE table_name IN ({_LIST}) UNION ALL SELECT 'orders', 'orders_by_customer', false)"
_system(
    "sys_pg_index",
    "pg_index",
    f"SELECT {_oid('index', 'i')} AS indexrelid, {_oid('table', 't')} AS indrelid, CASE t WHEN 'lineitem' THEN 2 WHEN 'conversations' THEN 2 ELSE 1 END AS indnatts, u AS indisunique, u AS indisprimary, CASE WHEN NOT u THEN '2' WHEN t = 'lineitem' THEN '1 4' WHEN t = 'conversations' THEN '1 2' ELSE '1' END AS indkey FROM {_INDEXES}",
    "indexrelid", "indrelid", "indnatts", "indisunique", "indisprimary", "indkey",
)
_system("sys_pg_constraint", "pg_constraint", f"SELECT table_name || '_pkey' AS conname, 'p' AS contype FROM information_schema.tables WHERE table_name IN ({_LIST}) UNION ALL SELECT table_name || '_' || column_name || '_not_null', 'n' FROM information_schema.columns WHERE table_name || '.' || column_name IN ({', '.join(repr(f'{t}.{k}') for t, ks in _KEYS.items() for k in ks)}) UNION ALL SELECT 'nation_region_fkey', 'f'", "conname", "contype")
_system("sys_pg_class", "pg_class", f"SELECT table_name AS relname, CAST(count(*) AS INTEGER) AS relnatts FROM information_schema.columns WHERE table_name IN ({_LIST}) GROUP BY table_name", "relname", "relnatts", where="relkind = 'r'")
_system("sys_pg_attribute", "pg_attribute", f"SELECT column_name AS attname, CAST(ordinal_position AS INTEGER) AS attnum, CASE data_type WHEN 'VARCHAR' THEN 25 WHEN 'DOUBLE' THEN 701 WHEN 'TIMESTAMP' THEN 1114 WHEN 'BIGINT' THEN 20 WHEN 'FLOAT[]' THEN 1021 ELSE 23 END AS atttypid FROM information_schema.columns WHERE table_name IN ({_LIST})", "attname", "attnum", "atttypid")
#: PostgreSQL's base types, as its documentation of pg_type lists them: oid, name, length, category.
_BASE = """
    (16, 'bool', 1, 'B'), (17, 'bytea', -1, 'U'), (18, 'char', -1, 'S'), (19, 'name', 64, 'S'), (20, 'int8', 8, 'N'), (21, 'int2', 2, 'N'), (23, 'int4', 4, 'N'), (25, 'text', -1, 'S'),
    (26, 'oid', 4, 'O'), (28, 'xid', 4, 'O'), (114, 'json', -1, 'U'), (650, 'cidr', -1, 'I'), (700, 'float4', 4, 'N'), (701, 'float8', 8, 'N'), (869, 'inet', -1, 'I'), (1009, '_text', -1, 'A'),
    (1021, '_float4', -1, 'A'), (1022, '_float8', -1, 'A'), (1042, 'bpchar', -1, 'S'), (1043, 'varchar', -1, 'S'), (1082, 'date', 4, 'D'), (1083, 'time', 8, 'D'), (1114, 'timestamp', 8, 'D'),
    (1184, 'timestamptz', 8, 'D'), (1700, 'numeric', -1, 'N'), (2950, 'uuid', 16, 'U'), (3802, 'jsonb', -1, 'U')
"""
_system(
    "sys_pg_type",
    "pg_type",
    f"SELECT CAST(o AS BIGINT) AS oid, n AS typname, l AS typlen, c AS typcategory, 'b' AS typtype, CAST(0 AS BIGINT) AS typrelid FROM (VALUES {_BASE}) v(o, n, l, c) UNION ALL SELECT {_oid('type', 'table_name')}, table_name, -1, 'C', 'c', {_oid('table', 'table_name')} FROM information_schema.tables WHERE table_name IN ({_LIST})",
    "oid", "typname", "typlen", "typcategory", "typtype", "typrelid",
)
_system("sys_pg_namespace", "pg_namespace", "SELECT 'pg_catalog' AS nspname, CAST(11 AS BIGINT) AS oid UNION ALL SELECT 'public', 2200 UNION ALL SELECT 'information_schema', 13000", "nspname", "oid")
_system("sys_pg_database", "pg_database", "SELECT 'granary' AS datname, true AS datallowconn", "datname", "datallowconn")
_system("sys_pg_views", "pg_views", "SELECT 'rich_customers' AS viewname, 'SELECT * FROM customer WHERE c_acctbal > 5000' AS definition", "viewname", "definition")
_system("sys_pg_inherits", "pg_inherits", "SELECT CAST(0 AS BIGINT) AS inhrelid, CAST(0 AS BIGINT) AS inhparent, 0 AS inhseqno WHERE false")
_system("sys_pg_proc", "pg_proc", "SELECT CAST(0 AS BIGINT) AS oid, '' AS proname, 0 AS pronamespace, 0 AS proowner, 0 AS prolang, 0 AS pronargs, CAST(0 AS BIGINT) AS prorettype WHERE false")
_system("sys_stat_tables", "pg_stat_user_tables", " UNION ALL ".join(f"SELECT '{t}' AS relname, count(*) AS n_live_tup FROM {t}" for t in _KEYS), "relname", "n_live_tup")
_system("sys_stat_indexes", "pg_stat_user_indexes", f"SELECT {_oid('table', 't')} AS relid, {_oid('index', 'i')} AS indexrelid, 'public' AS schemaname, t AS relname, i AS indexrelname, CAST(0 AS BIGINT) AS idx_scan, CAST(0 AS BIGINT) AS idx_tup_read, CAST(0 AS BIGINT) AS idx_tup_fetch FROM {_INDEXES}")
_system("sys_stat_database", "pg_stat_database", f"SELECT {_oid('database', chr(39) + 'granary' + chr(39))} AS datid, 'granary' AS datname, 1 AS numbackends, CAST(0 AS BIGINT) AS xact_commit, CAST(0 AS BIGINT) AS xact_rollback")
_system("sys_stat_bgwriter", "pg_stat_bgwriter", "SELECT CAST(0 AS BIGINT) AS checkpoints_timed, CAST(0 AS BIGINT) AS checkpoints_req, CAST(0 AS BIGINT) AS buffers_checkpoint, CAST(0 AS BIGINT) AS buffers_clean")
_VALUES = "(SELECT name, value, count(*) AS n FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {0}) UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(*))) GROUP BY ALL)"
_system(
    "sys_pg_stats",
    "pg_stats",
    " UNION ALL ".join(f"SELECT 'public' AS schemaname, '{t}' AS tablename, name AS attname, round(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) / sum(n), 8) AS null_frac, count(value) AS n_distinct FROM {_VALUES.format(t)} GROUP BY name" for t in _KEYS),
    "schemaname", "tablename", "attname", "null_frac", "n_distinct",
)


@register(
    "sys_pg_stats_texts",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS tablename, '{c}' AS attname, (SELECT round(avg(octet_length(encode({c}))), 6) FROM {t}) AS avg_width,
        (SELECT '{{' || string_agg(v, ',' ORDER BY n DESC, v) || '}}' FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY {c} ORDER BY n DESC, v LIMIT 3)) AS most_common_vals,
        (SELECT '{{' || min(v) || ',' || min(CASE WHEN i = n // 2 THEN v END) || ',' || max(v) || '}}' FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM {t})) AS histogram_bounds"""
        for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_type"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("nation", "n_name"), ("documents", "source"))
    ),
)
def sys_pg_stats_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Common values and bounds of text columns, whose texts are the same in any engine."""
    wanted = {"customer": ["c_name", "c_mktsegment"], "part": ["p_type"], "orders": ["o_orderpriority"], "lineitem": ["l_returnflag"], "nation": ["n_name"], "documents": ["source"]}
    counts = [statistics.counted(table(spark, folder, t), names).withColumn("attname", F.concat(F.lit(f"{t}."), F.col("attname"))) for t, names in wanted.items()]
    found = statistics.stats_of_counts(reduce(DataFrame.union, counts), {f"{t}.{c}": None for t, names in wanted.items() for c in names})
    name = F.split("attname", r"\.")
    return found.select(name[0].alias("tablename"), name[1].alias("attname"), F.round("avg_width", 6).alias("avg_width"), "most_common_vals", "histogram_bounds")


@register("fn_version", "SELECT 'granary 1.0 on Spark' AS version, 'granary' AS current_database, 'public' AS current_schema, 'granary' AS current_user")
def fn_version(spark: SparkSession, folder: str) -> DataFrame:
    values = session_values()
    return spark.range(1).select(*(F.lit(values[k]).alias(k) for k in ("version", "current_database", "current_schema", "current_user")))
