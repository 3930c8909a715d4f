"""Crawled pages: scan, one text per URL, cover images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan out over all cores when it has fewer splits than that.

    A small file with one row group is one task otherwise. Large inputs have
    more splits than cores and pass unchanged, so no big table is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def distinct_pages(pages: DataFrame, url: Column) -> DataFrame:
    """One page per URL, the first by ``page_id``.

    Only (page_id, url) is grouped; the texts are fetched by the surviving
    ids, so copies of one URL never carry their HTML into the same task.
    """
    first = pages.groupBy(url.alias("_u")).agg(F.min("page_id").alias("page_id")).select("page_id")
    return pages.join(first, "page_id", "left_semi")


# File extensions by media type; any other image is a jpg.
EXTENSIONS = {"image/png": "png", "image/webp": "webp", "image/gif": "gif"}


def cover_files(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Keep images only; append ``media_type`` and ``file_name``. A missing cover is no error."""
    sent = F.coalesce(F.col(content_type), F.lit("application/octet-stream"))
    media = F.trim(F.split_part(sent, F.lit(";"), F.lit(1)))
    named = F.lit("jpg")
    for kind, extension in EXTENSIONS.items():
        named = F.when(F.col("media_type") == kind, F.lit(extension)).otherwise(named)
    return (
        df.withColumn("media_type", media)
        .filter(F.col("media_type").startswith("image/"))
        .withColumn("file_name", F.concat(F.lit("cover."), named))
    )


def media_type_of(content: Column) -> Column:
    """The media type that a file's first bytes tell; null if they are no known image's."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("image/gif"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"))
    )


def stored_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder: file, content, content_type; other files have no type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", media_type_of(F.col("content")).alias("content_type"))


def book_covers(books: DataFrame, images: DataFrame) -> DataFrame:
    """(novel_id, cover, media_type, cover_file) of books (novel_id, cover_url) whose cover is among ``images`` (url, content, content_type).

    Only the books' keys meet the images; a book without a usable one is left out.
    """
    wanted = books.select("novel_id", F.col("cover_url").alias("url")).filter("url is not null")
    usable = cover_files(images.filter("content is not null"))
    one = usable.select("url", "content", "media_type", "file_name")
    return wanted.join(one, "url").select("novel_id", F.col("content").alias("cover"), "media_type", F.col("file_name").alias("cover_file"))
