"""The engine's session: a Spark session of its own with the rules of the SQL surface, tables and user variables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions import udfs

#: Casts, zero divisors and overflow give NULL or wrap instead of raising; the last of duplicate map keys wins.
RULES = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Engine:
    """sql() takes the dialect, scan() starts a builder, tables are views or keyed stores."""

    def __init__(self, spark: SparkSession, dialect: str = "neutral", root: str | None = None):
        self.spark = spark.newSession()
        for k, v in RULES.items():
            self.spark.conf.set(k, v)
        self.dialect, self.variables, self.functions, self.udfs = dialect, {}, {}, False
        from .sources.tables import Store

        self.store = Store(self, root)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES, dialect: str = "neutral") -> Engine:
        """An engine whose views are the Parquet tables of a folder. Only named tables are looked up."""
        engine = cls(spark, dialect)
        for name in names:
            engine.view(name, engine.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return engine

    def view(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        return df

    def sql(self, text: str, dialect: str | None = None, args: list | None = None) -> DataFrame:
        """One or more statements; the last one's result. args stand for ? in turn, or for $1, $2.. ."""
        from .plans.statements import bound, execute

        return execute(self, bound(text, args) if args else text, dialect or self.dialect)

    def ready(self, text: str) -> str:
        """Registers the functions that need Python when a text first names one."""
        if not self.udfs and (" sf_" in f" {text}".replace("(", " ") or "mann_whitney" in text):
            udfs.register(self.spark)
            self.udfs = True
        return text

    def named(self, text: str) -> str:
        """Names of two parts, of catalog tables and of stored ones, are one name here: information_schema.tables, db.t."""
        if re.search(r"\b(information_schema|pg_catalog)\s*\.", text, re.I):
            from .sources import catalog

            catalog.register(self)
            text = re.sub(r"\b(information_schema|pg_catalog)\s*\.\s*(\w+)", lambda m: f"{m[1]}__{m[2]}".lower(), text, flags=re.I)
        for name in self.store.versions:
            if "__" in name:
                a, b = name.split("__", 1)
                text = re.sub(rf"\b{re.escape(a)}\s*\.\s*{re.escape(b)}\b", name, text, flags=re.I)
        return text

    def run(self, text: str) -> DataFrame:
        return self.spark.sql(self.ready(self.named(text)))

    def scan(self, name: str):
        from .plans.builder import Query

        return Query(self, self.spark.table(name))
