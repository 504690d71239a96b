"""information_schema and pg_catalog tables from the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Type names of the catalogs.
PG_OIDS = {"boolean": 16, "bigint": 20, "smallint": 21, "int": 23, "string": 25, "float": 700, "double": 701, "date": 1082, "timestamp_ntz": 1114}


def register(engine) -> list[str]:
    """Views information_schema__tables, information_schema__columns, pg_catalog__pg_class, .. over the session's views."""
    spark = engine.spark
    tables = [(t.name, [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(t.name).schema]) for t in spark.catalog.listTables()]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    views: dict[str, DataFrame] = {
        "information_schema__tables": make([("def", "default", n, "BASE TABLE") for n, _ in tables], "table_catalog string, table_schema string, table_name string, table_type string"),
        "information_schema__columns": make([("default", n, c, i + 1, k, "YES" if null else "NO") for n, cols in tables for i, (c, k, null) in enumerate(cols)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"),
        "information_schema__schemata": make([("def", d.name) for d in spark.catalog.listDatabases()], "catalog_name string, schema_name string"),
        "pg_catalog__pg_namespace": make([(11, "pg_catalog"), (2200, "public")], "oid int, nspname string"),
        "pg_catalog__pg_database": make([(i + 1, d.name) for i, d in enumerate(spark.catalog.listDatabases())], "oid int, datname string"),
        "pg_catalog__pg_class": make([(16384 + i, n, 2200, "r") for i, (n, _) in enumerate(tables)], "oid int, relname string, relnamespace int, relkind string"),
        "pg_catalog__pg_attribute": make([(16384 + t, c, PG_OIDS.get(k, 25), i + 1, not null) for t, (_, cols) in enumerate(tables) for i, (c, k, null) in enumerate(cols)], "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean"),
        "pg_catalog__pg_type": make([(o, k) for k, o in PG_OIDS.items()], "oid int, typname string"),
        "pg_catalog__pg_tables": make([("public", n) for n, _ in tables], "schemaname string, tablename string"),
    }
    for name, df in views.items():
        engine.view(name, df)
    return list(views)
