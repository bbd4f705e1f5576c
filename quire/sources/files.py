"""Input files as rows: kinds by content, stems, page ranges, and the folders and files of the results.

Files are read by Spark's binaryFile source, so any store that Spark knows works; each file is one row.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# First bytes by kind, and the folder that tells the Office packages apart.
MAGIC = (("pdf", b"%PDF"), ("png", b"\x89PNG\r\n\x1a\n"), ("jpg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("bmp", b"BM"), ("tiff", b"II*\x00"), ("tiff", b"MM\x00*"), ("jp2", b"\x00\x00\x00\x0cjP  "))
PACKAGES = (("docx", "word/"), ("pptx", "ppt/"), ("xlsx", "xl/"))
IMAGES, OFFICE = ("png", "jpg", "gif", "bmp", "tiff", "webp", "jp2"), ("docx", "pptx", "xlsx")


def kind_of_bytes(data: bytes | None) -> str:
    """pdf, an image kind, docx, pptx, xlsx or an empty string."""
    data = data or b""
    for kind, first in MAGIC:
        if data.startswith(first):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data.startswith(b"PK"):
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return ""
        if "[Content_Types].xml" in names:
            return next((kind for kind, top in PACKAGES if any(n.startswith(top) for n in names)), "")
    return ""


def sniff(content: Column) -> Column:
    @pandas_udf("string")
    def kinds(values: pd.Series) -> pd.Series:
        return values.map(kind_of_bytes)

    return kinds(content)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?<=.)\.[^.]*$", "")


def unique_stems(files: DataFrame, name: str = "stem", order: str = "path", most: int = 200) -> DataFrame:
    """files with task_stem: names that differ but for case get _1, _2 .. in order; names are cut to most - 8 bytes of UTF-8 first."""
    kept = F.decode(F.substring(F.encode(F.col(name), "UTF-8"), 1, most - 8), "UTF-8")
    short = F.when(F.octet_length(name) <= most - 8, F.col(name)).otherwise(F.regexp_replace(kept, "�+$", ""))
    rows = files.withColumn("_short", short)
    number = F.row_number().over(Window.partitionBy(F.lower("_short")).orderBy(order)) - 1
    return rows.withColumn("_n", number).withColumn("task_stem", F.when(F.col("_n") == 0, F.col("_short")).otherwise(F.concat_ws("_", "_short", F.col("_n").cast("string")))).drop("_short", "_n")


def inputs(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("pdf", *IMAGES, *OFFICE)) -> DataFrame:
    """path, kind, stem, task_stem, content of every file under path that the engine reads; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.withColumn("kind", sniff(F.col("content"))).where(F.col("kind").isin(*kinds)).withColumn("stem", stem(F.col("path")))
    named = unique_stems(files.select("path", "stem"))
    return files.select("path", "kind", "content").join(named, "path").select("path", "kind", "stem", "task_stem", "content")


def read_range(content: Column, offset: Column | int, limit: Column | int) -> Column:
    """limit bytes from offset; a negative limit means to the end."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    offset, limit = lit(offset), lit(limit)
    return F.when(limit < 0, F.substring(content, (offset + 1).cast("int"), F.octet_length(content))).otherwise(F.substring(content, (offset + 1).cast("int"), limit.cast("int")))


def last_page(wanted: Column, pages: Column) -> Column:
    """The last page number to read: the wanted one, or the document's last where that is null, negative or beyond."""
    return F.when(wanted.isNull() | (wanted < 0), pages - 1).otherwise(F.least(wanted, pages - 1))


def effective_pages(first: Column, wanted: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0), last_page(wanted, pages) - first + 1)


def result_folder(stem: Column, backend: Column, method: Column, is_office: Column) -> Column:
    """Where the results of a document go: its name, then office, vlm, hybrid_<method> or the method."""
    kind = F.when(is_office, F.lit("office")).when(backend.startswith("vlm"), F.lit("vlm")).when(backend.startswith("hybrid"), F.concat(F.lit("hybrid_"), method)).otherwise(method)
    return F.concat_ws("/", stem, kind)


def write_markdown(documents: DataFrame, out: str, key: str = "doc_id", text: str = "markdown") -> None:
    """One text file in a folder for each document (out/key=.../part-*.txt)."""
    documents.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(out)


def write_json(rows: DataFrame, out: str) -> None:
    rows.write.mode("overwrite").json(out)


def data_uri_images(html: DataFrame, key: str = "doc_id", column: str = "html") -> DataFrame:
    """key, image_path, content: every distinct image embedded in HTML, named by its checksum."""
    uris = F.regexp_extract_all(F.col(column), F.lit(r'src="(data:image/[^"]+)"'), F.lit(1))
    rows = html.select(key, F.explode(uris).alias("uri"))
    suffix = F.regexp_extract("uri", r"^data:image/([A-Za-z0-9]+)", 1)
    body = F.regexp_extract("uri", r"base64,(.*)$", 1)
    return rows.select(key, F.concat(F.sha2("uri", 256), F.lit("."), suffix).alias("image_path"), F.try_to_binary(body, F.lit("base64")).alias("content")).dropDuplicates([key, "image_path"])


def without_data_uris(html: Column, folder: str = "images") -> Column:
    """HTML with every embedded image replaced by its file's path."""
    uris = F.array_distinct(F.regexp_extract_all(html, F.lit(r'src="(data:image/[^"]+)"'), F.lit(1)))
    name = lambda u: F.concat(F.lit(f"{folder}/"), F.sha2(u, 256), F.lit("."), F.regexp_extract(u, r"^data:image/([A-Za-z0-9]+)", 1))
    return F.aggregate(uris, html, lambda h, u: F.replace(h, u, name(u)))
