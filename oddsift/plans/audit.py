"""The log of inputs and analyses: append-only Parquet tables, and versions of the table of inputs.

Removing expired inputs writes the survivors as the next version, names it in the table of versions, and then deletes
the old version's folder. One process at a time may remove; readers see the old or the new version.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsift.plans.analyze import Analysis, Parameters, analyze
from oddsift.session import materialize

TTL_MINUTES = 10  # fixed value: how long an input is kept

FILES = (
    "id string, filename string, storage_key string, size_bytes bigint, sha256 string, rows bigint, "
    "columns array<struct<name:string,type:string,missing:bigint,unique:bigint>>, created_at timestamp"
)
VERSIONS = "version int"
ANALYSES = (
    "id string, file_id string, filename string, sha256 string, "
    "parameters struct<models:array<string>,numeric_columns:array<string>,categorical_columns:array<string>,threshold:double>, "
    "summary struct<rows:bigint,flagged_rows:bigint,flagged_by_majority:bigint,models_run:int,por_modelo:map<string,bigint>>, "
    "fingerprint string, created_at timestamp"
)


class AuditLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        if not self._exists("versions"):
            self._write(spark.createDataFrame([], FILES), "files-0")
            self._write(spark.createDataFrame([], ANALYSES), "analyses")
            self._write(spark.createDataFrame([(0,)], VERSIONS), "versions")

    def _path(self, table: str) -> str:
        return os.path.join(self.folder, table)

    def _hadoop(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, table: str) -> bool:
        system, path = self._hadoop(table)
        return system.exists(path)

    def _write(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(self._path(table))

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _version(self) -> int:
        return self._read("versions", VERSIONS).agg(F.max("version")).first()[0]

    def append_files(self, records: DataFrame) -> None:
        wanted = T.StructType.fromDDL(FILES)
        self._write(records.select(*[F.col(f.name).cast(f.dataType) for f in wanted]), f"files-{self._version()}")

    def files(self) -> DataFrame:
        return self._read(f"files-{self._version()}", FILES)

    def file(self, file_id: str) -> DataFrame:
        return self.files().filter(F.col("id") == file_id)

    def file_fields(self, file_id: str) -> DataFrame:
        return self.file(file_id).select("id", "filename", "sha256", "size_bytes", "rows")

    def files_older_than(self, limit: datetime) -> DataFrame:
        return older_than(self.files(), limit)

    def retain(self, minutes: int = TTL_MINUTES, now: datetime | None = None) -> DataFrame:
        """Remove inputs older than ``minutes`` and return their ids; analyses are not touched."""
        old = self._version()
        expired, kept = split_expired(self.files(), minutes, now)
        removed = materialize(expired, "expired")
        self._write(kept, f"files-{old + 1}")
        self._write(self.spark.createDataFrame([(old + 1,)], VERSIONS), "versions")
        system, path = self._hadoop(f"files-{old}")
        system.delete(path, True)
        return removed

    def append_analysis(self, a: Analysis, file_id: str, filename: str, sha256: str, now: datetime | None = None) -> None:
        self._write(analysis_record(a, file_id, filename, sha256, now), "analyses")

    def analyses(self, file_id: str | None = None) -> DataFrame:
        return history(self._read("analyses", ANALYSES), file_id)

    def known(self, file_id: str, fingerprint: str) -> bool:
        """Whether this input was already analysed with these parameters."""
        seen = self.analyses(file_id).filter(F.col("fingerprint") == fingerprint)
        return not seen.isEmpty()

    def append_analyses(self, records: DataFrame) -> None:
        """Log many analyses at once; columns that ``records`` lacks become null."""
        wanted, given = T.StructType.fromDDL(ANALYSES), set(records.columns)
        cells = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        self._write(records.select(*cells), "analyses")

    def unseen(self, requests: DataFrame) -> DataFrame:
        """The requests, told by ``file_id`` and ``fingerprint``, that the log does not answer yet.

        One anti join looks all of them up. A pair counts once however often it was logged; repeated requests stay
        repeated, and one without id or fingerprint is always unseen.
        """
        pair = ["file_id", "fingerprint"]
        return requests.join(self._read("analyses", ANALYSES).select(*pair).distinct(), pair, "left_anti")

    def analyze_once(self, df: DataFrame, params: Parameters, file_id: str, filename: str, sha256: str, row_id: str = "row_id") -> Analysis | None:
        """Analyse and log an input, or return None if the log already has it with these parameters."""
        params.check(df.columns)
        if self.known(file_id, params.fingerprint()):
            return None
        a = analyze(df, params, row_id)
        self.append_analysis(a, file_id, filename, sha256)
        return a


def older_than(files: DataFrame, limit: datetime) -> DataFrame:
    return files.filter(F.col("created_at") < F.lit(limit))


def split_expired(files: DataFrame, minutes: int = TTL_MINUTES, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    limit = (now or datetime.now(timezone.utc)) - timedelta(minutes=minutes)
    # by the time of each record alone: a record with the id of an older one stays
    young = ~F.coalesce(F.col("created_at") < F.lit(limit), F.lit(False))
    return older_than(files, limit).select("id"), files.filter(young)


def history(analyses: DataFrame, file_id: str | None = None) -> DataFrame:
    wanted = analyses if file_id is None else analyses.filter(F.col("file_id") == file_id)
    return wanted.orderBy("created_at", "id")


def parameters_column(p: Parameters) -> Column:
    lists = {"models": p.models, "numeric_columns": p.numeric_columns, "categorical_columns": p.categorical_columns}
    names = [F.array(*[F.lit(x) for x in xs]).cast("array<string>").alias(k) for k, xs in lists.items()]
    return F.struct(*names, F.lit(p.threshold).alias("threshold"))


def analysis_record(a: Analysis, file_id: str, filename: str, sha256: str, now: datetime | None = None) -> DataFrame:
    counts = a.model_summary().agg(
        F.map_from_entries(F.collect_list(F.struct("id", "anomalies"))).alias("por_modelo")
    )
    p = a.params
    row = a.summary().crossJoin(counts).select(
        F.lit(str(uuid.uuid4())).alias("id"), F.lit(file_id).alias("file_id"), F.lit(filename).alias("filename"),
        F.lit(sha256).alias("sha256"),
        parameters_column(p).alias("parameters"),
        F.struct("rows", "flagged_rows", "flagged_by_majority", "models_run", "por_modelo").alias("summary"),
        F.lit(p.fingerprint()).alias("fingerprint"),
        F.lit(now or datetime.now(timezone.utc)).alias("created_at"),
    )
    wanted = T.StructType.fromDDL(ANALYSES)
    return row.select(*[F.col(f.name).cast(f.dataType) for f in wanted])
