"""Tables as Parquet files in a folder that all executors share.

A statement never changes a file: INSERT adds one, UPDATE and DELETE write the rows anew, and the catalog's list of paths is
swapped when all is written.  Snapshots are therefore lists of paths, and lineage never grows with the number of statements.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..catalog import Catalog, Index, Table
from ..errors import StoreError
from ..plans.parser import ColumnDef
from ..types import from_name, name_of, sql_type


def load_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spark_schema(columns: list[ColumnDef]) -> T.StructType:
    """The schema of a table's files; encrypted columns are binary."""
    return T.StructType([T.StructField(c.name, T.BinaryType() if c.encrypted else T.StructType.fromDDL(f"x {sql_type(c.type)}")["x"].dataType, True) for c in columns])


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is named and all runs on this
    machine, as in tests.  Elsewhere executors could not read what others wrote, so that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not is_local(sc.master):
            raise StoreError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlwick-"))
    return named or str(sc.getCheckpointDir())


class Store:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def read(self, table: Table) -> DataFrame:
        if table.frame is not None:
            return table.frame
        schema = spark_schema(table.columns)
        if not table.paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*table.paths)

    # --- durable checkpoints

    def _file(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def checkpoint(self, catalog: Catalog, folder: str) -> None:
        """Writes all tables and the catalog.  The catalog's file comes last, by a rename over the one before, so that there is a
        whole image at any time; a checkpoint without that file is none."""
        version = uuid.uuid4().hex
        tables = {}
        for key, t in catalog.tables.items():
            path = f"{folder}/{version}/{key}"
            self.read(t).write.parquet(path)
            tables[key] = {"owner": t.owner, "path": path, "columns": [{"name": c.name, "type": name_of(c.type), "nullable": c.nullable, "encrypted": c.encrypted, "generated": _listed(c.generated), "references": _listed(c.references)} for c in t.columns]}
        image = {
            "tables": tables,
            "indexes": [[i.name, i.table, _listed(i.keys), i.method, i.unique] for i in catalog.indexes.values()],
            "roles": sorted(catalog.roles), "superusers": sorted(catalog.superusers), "decryptors": sorted(catalog.decryptors),
            "grants": [_listed(g) for g in sorted(catalog.grants, key=str)],
            "policies": {k: {n: _listed(p) for n, p in v.items()} for k, v in catalog.policies.items()},
            "triggers": {k: list(v) for k, v in catalog.triggers.items()},
            "procedures": [[n, [name_of(t) for t in kinds], body] for (n, kinds), body in catalog.procedures.items()],
            "deny_by_default": catalog.deny_by_default,
        }
        fs, path = self._file(f"{folder}/catalog.{version}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(image).encode()))
        out.close()
        _, final = self._file(f"{folder}/catalog.json")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), fs.getConf()).rename(fs.makeQualified(path), fs.makeQualified(final), over)

    def restore(self, folder: str) -> Catalog:
        fs, path = self._file(f"{folder}/catalog.json")
        stream = fs.open(path)
        data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        image, out = json.loads(data), Catalog()
        for key, t in image["tables"].items():
            columns = [ColumnDef(c["name"], from_name(c["type"]), c["nullable"], c["encrypted"], _tupled(c["generated"]), _tupled(c["references"])) for c in t["columns"]]
            out.tables[key] = Table(key, columns, t["owner"], [t["path"]])
        for n, table, keys, method, unique in image["indexes"]:
            out.indexes[n] = Index(n, table, _tupled(keys), method, unique)
        out.roles, out.superusers, out.decryptors = set(image["roles"]), set(image["superusers"]), set(image["decryptors"])
        out.grants = {_tupled(g) for g in image["grants"]}
        out.policies = {k: {n: _tupled(p) for n, p in v.items()} for k, v in image["policies"].items()}
        out.triggers = {k: tuple(v) for k, v in image["triggers"].items()}
        out.procedures = {(n, tuple(map(from_name, kinds))): body for n, kinds, body in image["procedures"]}
        out.deny_by_default = image["deny_by_default"]
        return out


def _listed(x):
    return [_listed(v) for v in x] if isinstance(x, tuple) else x


def _tupled(x):
    return tuple(map(_tupled, x)) if isinstance(x, list) else x
