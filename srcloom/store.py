"""Stored tables: Parquet partitioned by repository, replaced a repository at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.schemas import TABLES


class UnknownRepository(LookupError):
    """No index for this repository."""


class Store:
    """The tables of all repositories.  What was read of a repository is kept until it is written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[tuple[str, str], DataFrame] = {}
        self._known: set[str] = set()

    def _folder(self, name: str, repo_id: str) -> str:
        if not repo_id:
            raise ValueError("a repository needs a name")
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.root}/{name}/repo_id={escape(repo_id)}"

    def replace(self, name: str, repo_id: str, rows: DataFrame) -> None:
        """Make rows, all of one repository, that repository's table; without rows it is empty afterwards.  Others stay."""
        columns = [c.strip().split(" ")[0] for c in TABLES[name].replace("array<string>", "a").split(",")]
        rows.select(*[c for c in columns if c != "repo_id"]).write.mode("overwrite").parquet(self._folder(name, repo_id))

    def forget(self, repo_id: str) -> None:
        """Drop what was kept of a repository, after it was written."""
        self._known.discard(repo_id)
        for key in [k for k in self._open if k[1] == repo_id]:
            self._open.pop(key)

    def read(self, name: str, repo_id: str | None = None) -> DataFrame:
        """The table of a repository, or of all."""
        key = (name, repo_id or "")
        if repo_id is None or key not in self._open:
            try:
                rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    raise UnknownRepository(repo_id or name) from None
                raise
            if repo_id is None:
                return rows
            self._open[key] = rows.where(F.col("repo_id") == repo_id)
        return self._open[key]

    def require(self, repo_id: str) -> None:
        """UnknownRepository unless the repository has been ingested; a repository without chunks counts as such."""
        if repo_id in self._known:
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder("vectors", repo_id))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            raise UnknownRepository(repo_id)
        self._known.add(repo_id)
