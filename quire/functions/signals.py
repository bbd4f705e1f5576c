"""Is a document's text layer usable (txt) or has it to be recognised (ocr)?

Page samples are rows (doc_id, page_index, text). Every signal is an aggregate of counts by regular expression, and the decision is one
disjunction over them, so a document costs one pass and one row for each sampled page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import no_space

# Thresholds of the signals.
MAX_SAMPLE_PAGES = 10
LEAST_CHARS_A_PAGE = 50
MAX_ASPECT_RATIO = 10.0
IMAGE_COVERAGE = 0.8
QUALITY_MIN_CHARS, QUALITY_BAD_SHARE = 300, 0.03
MAP_ERROR_SHARE = 0.04
FONT_MIN_CHARS, FONT_SHARE, FONT_CJK_SHARE = 30, 0.01, 0.8
PUNCT_RUN, PUNCT_MIN_CHARS, PUNCT_SHARE, PUNCT_RUN_SHARE = 4, 100, 0.25, 0.10
PRIVATE_MIN, PRIVATE_RUN, PRIVATE_SHARE = 2, 2, 0.05
U72_COUNT, U72_SHARE = 30, 0.026
CROSS_MIN_CHARS, CROSS_MIN_CJK, CROSS_COUNT, CROSS_SHARE, CROSS_SCRIPTS, CROSS_SCRIPT_CHARS = 300, 100, 120, 0.18, 3, 5

PUNCT = r"[!-/:-@\[-`{-~]"
PRIVATE = r"[-]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
CJK = r"[一-鿿]"


def sample_pages(pages: Column, most: int = MAX_SAMPLE_PAGES) -> Column:
    """Evenly spaced page numbers from 0, the first and the last among them; halves go to the even number."""
    last, steps = pages - 1, most - 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.rint(F.try_divide(i * last, F.lit(steps))).cast("int"))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= most, F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).otherwise(F.array_distinct(spread))


def punctuation_runs(text: Column) -> Column:
    """Runs of at least PUNCT_RUN ASCII marks, as strings."""
    return F.regexp_extract_all(text, F.lit(PUNCT + f"{{{PUNCT_RUN},}}"), F.lit(0))


def page_signals(samples: DataFrame) -> DataFrame:
    """doc_id, page_index, chars, punct, run_chars, run_kinds, odd_punct of every sampled page."""
    clean = no_space(F.coalesce(F.col("text"), F.lit("")))
    rows = samples.select("doc_id", "page_index", clean.alias("clean")).withColumn("runs", punctuation_runs(F.col("clean")))
    rows = rows.select(
        "doc_id", "page_index", F.length("clean").cast("long").alias("chars"), F.regexp_count("clean", F.lit(PUNCT)).cast("long").alias("punct"),
        F.aggregate("runs", F.lit(0), lambda n, r: n + F.length(r)).cast("long").alias("run_chars"), F.size(F.array_distinct(F.split(F.array_join("runs", ""), ""))).alias("kinds"), (F.size("runs") > 0).alias("some"),
    )
    rows = rows.withColumn("run_kinds", F.when(F.col("some"), F.col("kinds")).otherwise(0).cast("long")).drop("kinds", "some")
    odd = (F.col("chars") >= PUNCT_MIN_CHARS) & (F.col("punct") >= PUNCT_SHARE * F.col("chars")) & (F.col("run_chars") >= PUNCT_RUN_SHARE * F.col("chars")) & (F.col("run_kinds") > 1)
    return rows.withColumn("odd_punct", odd)


def quality_signals(samples: DataFrame) -> DataFrame:
    """doc_id, total, abnormal, abnormal_ratio, bad_quality: nulls, replacement characters, controls and private use characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda p: F.sum(F.regexp_count(text, F.lit(p))).cast("long")
    got = samples.groupBy("doc_id").agg(F.sum(F.length(no_space(text))).cast("long").alias("total"), (count(CONTROL) + count(r"�") + count(PRIVATE)).alias("abnormal"))
    ratio = F.coalesce(F.try_divide(F.col("abnormal"), F.col("total")), F.lit(0.0))
    return got.withColumn("abnormal_ratio", F.round(ratio, 6)).withColumn("bad_quality", (F.col("total") >= QUALITY_MIN_CHARS) & (ratio >= QUALITY_BAD_SHARE))


def u72_signals(samples: DataFrame, common: str = "") -> DataFrame:
    """doc_id, u72, cjk, odd_u72: characters U+7280 to U+72DF but the common ones, a mark of broken maps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rare = rf"[犀-狟&&[^{common}]]" if common else r"[犀-狟]"
    got = samples.groupBy("doc_id").agg(F.sum(F.regexp_count(text, F.lit(rare))).cast("long").alias("u72"), F.sum(F.regexp_count(text, F.lit(CJK))).cast("long").alias("cjk"))
    return got.withColumn("odd_u72", (F.col("u72") >= U72_COUNT) & (F.col("u72") >= U72_SHARE * F.col("cjk")) & (F.col("cjk") > 0))


def script_signals(samples: DataFrame, scripts: dict[str, str]) -> DataFrame:
    """doc_id, total, cjk, foreign, dense_scripts, top_scripts, odd_scripts. scripts: character classes by name."""
    text = no_space(F.coalesce(F.col("text"), F.lit("")))
    counts = [F.sum(F.regexp_count(text, F.lit(p))).cast("long").alias(f"s_{k}") for k, p in scripts.items()]
    got = samples.groupBy("doc_id").agg(F.sum(F.length(text)).cast("long").alias("total"), F.sum(F.regexp_count(text, F.lit(CJK))).cast("long").alias("cjk"), *counts)
    each = [F.col(f"s_{k}") for k in scripts]
    foreign = sum(each[1:], each[0])
    dense = sum(((c >= CROSS_SCRIPT_CHARS).cast("long") for c in each[1:]), (each[0] >= CROSS_SCRIPT_CHARS).cast("long"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-c).alias("n"), F.lit(k).alias("name")) for k, c in zip(scripts, each, strict=True)]), lambda s: s["n"] < 0))
    got = got.withColumns({"foreign": foreign, "dense_scripts": dense, "top_scripts": F.array_join(F.transform(F.slice(ranked, 1, 5), lambda s: s["name"]), ",")})
    odd = (F.col("total") >= CROSS_MIN_CHARS) & (F.col("cjk") >= CROSS_MIN_CJK) & (F.col("foreign") >= CROSS_COUNT) & (F.col("foreign") >= CROSS_SHARE * F.col("total")) & (F.col("dense_scripts") >= CROSS_SCRIPTS)
    return got.withColumn("odd_scripts", odd).drop(*[f"s_{k}" for k in scripts])


def private_use(text: Column) -> Column:
    """struct(n, ratio, run, odd): private use characters of a span."""
    n = F.regexp_count(text, F.lit(PRIVATE)).cast("long")
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(PRIVATE + "+"), F.lit(0)), F.length)), F.lit(0)).cast("long")
    ratio = F.coalesce(F.try_divide(n, F.length(no_space(text))), F.lit(0.0))
    return F.struct(n.alias("n"), F.round(ratio, 6).alias("ratio"), run.alias("run"), ((n >= PRIVATE_MIN) & ((run >= PRIVATE_RUN) | (ratio >= PRIVATE_SHARE))).alias("odd"))


def font_signals(usage: DataFrame) -> DataFrame:
    """usage(doc_id, page_index, font, chars, cjk, cid, latin) -> doc_id, odd_cid, odd_latin.

    cid: the font has no Unicode map; latin: its character set is Latin though it has one. One odd page or font is enough.
    """
    pages = usage.groupBy("doc_id", "page_index").agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum(F.when(F.col("cid"), F.col("chars"))), F.lit(0)).alias("cid_chars"))
    odd_page = (F.col("cid_chars") >= FONT_MIN_CHARS) & (F.col("cid_chars") >= FONT_SHARE * F.col("all_chars"))
    fonts = usage.groupBy("doc_id", "page_index", "font").agg(F.sum("chars").alias("n"), F.sum("cjk").alias("c"), F.bool_or("latin").alias("latin"))
    odd_font = F.col("latin") & (F.col("n") >= FONT_MIN_CHARS) & (F.col("n") >= FONT_SHARE * F.col("all_chars")) & (F.col("c") >= FONT_CJK_SHARE * F.col("n"))
    met = fonts.join(pages, ["doc_id", "page_index"])
    return met.groupBy("doc_id").agg(F.bool_or(odd_page).alias("odd_cid"), F.bool_or(odd_font).alias("odd_latin"))


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, covered, odd_images: share of pages whose images cover IMAGE_COVERAGE of them or more. images(doc_id, page_index, area); pages(doc_id, page_index, area)."""
    sums = images.groupBy("doc_id", "page_index").agg(F.sum("area").alias("image_area"))
    share = F.least(F.coalesce(F.try_divide(F.col("image_area"), F.col("area")), F.lit(0.0)), F.lit(1.0))
    got = pages.join(sums, ["doc_id", "page_index"], "left").groupBy("doc_id").agg(F.avg((share >= IMAGE_COVERAGE).cast("double")).alias("covered"))
    return got.withColumns({"covered": F.round("covered", 6), "odd_images": F.col("covered") >= IMAGE_COVERAGE})


def classify(samples: DataFrame) -> DataFrame:
    """doc_id, avg_chars, method: ocr if the pages hold little text or any text signal is odd, else txt. A document without samples has no row."""
    pages = page_signals(samples).groupBy("doc_id").agg(F.avg("chars").alias("avg_chars"), F.bool_or("odd_punct").alias("odd_punct"))
    met = pages.join(quality_signals(samples), "doc_id").join(u72_signals(samples), "doc_id")
    odd = (F.col("avg_chars") < LEAST_CHARS_A_PAGE) | F.col("odd_punct") | F.col("bad_quality") | F.col("odd_u72")
    return met.select("doc_id", F.round("avg_chars", 6).alias("avg_chars"), F.when(odd, "ocr").otherwise("txt").alias("method"))
