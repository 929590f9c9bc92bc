"""A project's tables: their columns, and a folder that keeps them by version."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: The tables of a project and their columns. Times are seconds since 1970.
TABLES = {
    "materials": "id string, uri string, media_type string, processor string, content_hash string, size long, modified_at long",
    "nodes": "id string, label string, kind string, subkind string, ref string, owner string, state string, provenance string, material_id string, material_uri string, locator string, content string",
    "claims": "material_id string, source_id string, target_id string, target string, relation string",
    "edges": "source_id string, target_id string, relation string, owner string, provenance string",
    "memories": "key string, kind string, value string, source string, hash string, updated_at long",
    "versions": "key string, number long, kind string, value string, source string, hash string, created_at long",
    "reviews": "key string, source_type string, source_id string, content_hash string, reason string, status string, outcome string, version long, created_at long, resolved_at long",
    "requests": "session_id string, need string, status string, resolved_key string, created_at long, updated_at long, resolved_at long",
    "decisions": "id string, session_id string, input_hash string, input_text string, action string, proposal string, hints string, model string, fallback string, request string, created_at long",
    "feedback": "decision_id string, verdict string, expected_action string, expected_keys array<string>, note string, created_at long",
    "audit": "session_id string, changes string, created_at long",
    "resources": "id string, provider string, label string, identity string",
    "views": "id string, resource_id string, root string, branch string, revision string, dirty boolean, available boolean, observed_at long",
    "observations": "id string, provider string, label string, identity string, root string, observed_at long",
    "sessions": "id string, view_id string, agent string, status string, updated_at long",
    "deliveries": "session_id string, key string, kind string, label string, source string, preview string, hash string, delivered_at long",
    "embeddings": "node_id string, content_hash string, model string, vector array<double>",
    "settings": "name string, value string",
    "projects": "id string, name string, root string, registered boolean, updated_at long",
}

State = Mapping[str, DataFrame]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def new_state(spark: SparkSession, **tables: DataFrame) -> dict[str, DataFrame]:
    """All tables: those given, with the columns of TABLES (missing ones null), the others empty."""
    out = {}
    for name in TABLES:
        given = tables.get(name)
        out[name] = empty(spark, name) if given is None else empty(spark, name).unionByName(given, allowMissingColumns=True).select(*empty(spark, name).columns)
    return out


class Folder:
    """Tables in a folder that executors share. A version is a file that names where each of its tables lies.

    A change writes the new tables first and then creates the next version's file, which only one writer can; who
    comes second gets an error and has changed nothing. Reads take the newest version whole.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.root}/x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        top = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _places(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:09d}.json", wholetext=True).first()[0])

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        places = self._places(self.version() if version is None else version)
        read = lambda name: self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{places[name]}")
        return {name: read(name) if name in places else empty(self.spark, name) for name in TABLES}

    def save(self, changes: State, based_on: int | None = None) -> int:
        """The tables of changes in place of those of version based_on (the newest), the others as they were; its number."""
        old = self.version() if based_on is None else based_on
        places, mine = self._places(old), f"v{old + 1:09d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        for name, df in changes.items():
            df.select(*self.spark.createDataFrame([], TABLES[name]).columns).write.parquet(f"{self.root}/{mine}/{name}")
            places[name] = f"{mine}/{name}"
        out = self._fs.create(self._path(f"{self.root}/versions/{old + 1:09d}.json"), False)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        return old + 1
