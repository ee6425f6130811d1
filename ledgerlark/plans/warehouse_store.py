"""A warehouse of tables, published whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators.payload import Payload
from ledgerlark.plans.numbering import placed
from ledgerlark.plans.versions import Versions


class Warehouse:
    """One version of the tables: what it shows never changes, whatever is published after it was opened."""

    def __init__(self, spark: SparkSession, root: str, number: int, content: dict):
        self.spark, self.root, self.number, self._content = spark, root, number, content

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Warehouse:
        number, content = Versions(spark, root).current()
        if not number:
            raise FileNotFoundError(f"nothing is published in {root}")
        return cls(spark, root, number, content)

    @property
    def tables(self) -> list[str]:
        return sorted(self._content["folders"])

    def table(self, name: str) -> DataFrame:
        # the schema is kept, as empty tables may have no file
        return self.spark.read.schema(self._content["schemas"][name]).parquet(Versions(self.spark, self.root).data(self._content["folders"][name]))


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None, keep: int = 2, note: dict | None = None) -> int:
    """Writes all tables beside the published ones and then publishes them, with a note, as one version. The last `keep` versions stay readable."""
    versions = Versions(spark, root)
    after, _ = versions.current()
    content: dict = (note or {}) | {"folders": {}, "schemas": {}}
    for name, df in tables.items():
        folder = versions.fresh()
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(versions.data(folder))
        content["folders"][name] = folder
        content["schemas"][name] = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    number = versions.commit(after, content)
    versions.vacuum(keep)
    return number


def publish_payload(spark: SparkSession, payload: Payload, root: str) -> int:
    """Publishes a payload as one version: its JSON document (table document, one row), and the list of all sessions with their places (sessionsAll)."""
    sessions = placed(payload.sessions_all(), [F.desc("total"), F.col("id")])
    return publish(spark, {"document": payload.document(), "sessionsAll": sessions}, root)


def payload_json(warehouse: Warehouse) -> str:
    """The document of a published payload, as one text."""
    return warehouse.table("document").first()["payload"]
