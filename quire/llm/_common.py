"""Reading, lineage cuts and two-level numbering shared by the operators of this folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this folder, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one is made only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(Path(own).as_uri())
    return Path(own).as_uri()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes non-deterministic columns.
    The files are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _plain_scan(df: DataFrame) -> bool:
    """Whether every row of df is one row of a file: its plan is one scan under projections and filters."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _PLAIN:
        if node.children().isEmpty():
            return True
        node = node.children().head()
    return False


def named_rows(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with two longs that together name a row: the same in every scan, so a third of the rows under one id are still told apart.

    Parquet files number their rows already; only other inputs are written to the shared folder and numbered there.
    """
    if _plain_scan(docs):
        try:
            return docs.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")})
        except AnalysisException:  # not Parquet, or a column of that name
            pass
    return materialise(docs.withColumns({file: F.lit(0).cast("long"), row: F.monotonically_increasing_id()}))


#: Groups that may be sent to every task because each holds at least this share of the rows: no more than a thousand can.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with groups (one row for each value of on; size: the rows it has of total), hot groups without moving their rows."""
    hot = F.col(size) * HOT_SHARE >= total
    few = groups.where(hot)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(groups.where(~hot), on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def join_top(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows joined with groups (one row for each value of on). The HOT_SHARE largest by size go to every task; only rows of the others move."""
    top = groups.orderBy(F.desc(size), *on).limit(HOT_SHARE)
    rest = rows.join(F.broadcast(top.select(*on)), on, "left_anti").join(groups.join(F.broadcast(top.select(*on)), on, "left_anti"), on)
    return rows.join(F.broadcast(top), on).unionByName(rest)


def root_of(n: int) -> int:
    """How many buckets two-level numbering of n rows uses: both levels then hold about the same number of rows."""
    return max(1, round(n**0.5))


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


_shipped: set[str] = set()


def with_package(df: DataFrame) -> DataFrame:
    """df, once executors can import this package: its files go to them with the application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="quire-code-")
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / "quire_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, path.relative_to(top.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return df
