"""Registry of measurements, and the catalog tables that clients ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnknownMeasurement
from ..model import Measurement

# PostgreSQL names and numbers of the types used here.
_PG_TYPES = {
    "boolean": ("boolean", 16), "bigint": ("bigint", 20), "int": ("integer", 23), "string": ("text", 25), "double": ("double precision", 701), "float": ("real", 700),
    "timestamp": ("timestamp with time zone", 1184), "timestamp_ntz": ("timestamp without time zone", 1114), "date": ("date", 1082),
}
_EMPTY = "schemata views key_column_usage table_constraints referential_constraints constraint_column_usage routines parameters triggers sequences character_sets".split()
_SETTINGS = {"server_version": "16.0", "server_encoding": "UTF8", "client_encoding": "UTF8", "TimeZone": "UTC", "DateStyle": "ISO, MDY", "standard_conforming_strings": "on", "integer_datetimes": "on", "transaction_isolation": "read committed", "search_path": "public", "max_identifier_length": "63"}


class Catalog:
    def __init__(self, spark: SparkSession, database: str = "tidemark"):
        self.spark = spark
        self.database = database
        self._known: dict[str, tuple[Measurement, DataFrame]] = {}

    def register(self, m: Measurement, df: DataFrame) -> DataFrame:
        """Make ``df`` known under the measurement's name, as a view too."""
        marked = m.mark(df)
        self._known[m.name] = (m, marked)
        marked.createOrReplaceTempView(f"`{m.name}`" if not m.name.isidentifier() else m.name)
        return marked

    def drop(self, name: str) -> None:
        self._known.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def get(self, name: str) -> tuple[Measurement, DataFrame]:
        if name not in self._known:
            raise UnknownMeasurement(f"no measurement {name!r}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")

    def _columns(self) -> list[tuple]:
        out = []
        for name in self.names():
            for i, (column, dtype) in enumerate(self._known[name][1].dtypes, 1):
                out.append((self.database, "public", name, column, i, "NO" if column == "time" else "YES", *_PG_TYPES.get(dtype, ("text", 25))))
        return out

    def tables(self) -> dict[str, DataFrame]:
        """Catalog tables by view name; their size is that of the schema, not of the data."""
        make, db = self.spark.createDataFrame, self.database
        names = self.names()
        oid = {n: 16384 + i for i, n in enumerate(names)}
        columns = self._columns()
        text = lambda *cols: ", ".join(f"{c} string" for c in cols)
        types = sorted({(v[1], v[0]) for v in _PG_TYPES.values()})
        out = {
            "information_schema_tables": make([(db, "public", n, "BASE TABLE") for n in names], text("table_catalog", "table_schema", "table_name", "table_type")),
            "information_schema_columns": make(
                [c[:7] for c in columns], "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string"
            ),
            "pg_catalog_pg_database": make([(1, db)], "oid int, datname string"),
            "pg_catalog_pg_namespace": make([(11, "pg_catalog"), (2200, "public")], "oid int, nspname string"),
            "pg_catalog_pg_class": make([(oid[n], n, 2200, "r") for n in names], "oid int, relname string, relnamespace int, relkind string"),
            "pg_catalog_pg_settings": make([*_SETTINGS.items()], text("name", "setting")),
            "pg_catalog_pg_type": make(types, "oid int, typname string"),
            "pg_catalog_pg_attribute": make([(oid[c[2]], c[3], c[7], c[4]) for c in columns], "attrelid int, attname string, atttypid int, attnum int"),
        }
        for name in _EMPTY:
            out[f"information_schema_{name}"] = make([], text("table_catalog", "table_schema", "table_name"))
        return out

    def publish(self) -> None:
        """Make the catalog tables queryable."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)
            if name.startswith("pg_catalog_"):
                df.createOrReplaceTempView(name.removeprefix("pg_catalog_"))

    def setting(self, name: str) -> str:
        by_name = {k.lower(): v for k, v in _SETTINGS.items()}
        return by_name.get(name.lower().replace(" ", ""), "")
