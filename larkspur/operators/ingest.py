"""Importing files: manifests, keys, uploads, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9/_.-]*\.pdf$"
MB = 1 << 20
MAX_FILE, MIN_FILE, MAX_IMAGE, MAX_VIDEO, MAX_AVATAR, MAX_VIDEO_SECONDS = 100 * MB, 1024, 5 * MB, 50 * MB, 2 * MB, 30


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """key, url of a manifest's sources that have both; the limit counts these only."""
    rows = spark.read.schema("sources array<struct<key:string,url:string>>").json(path, multiLine=True).select(F.posexplode("sources").alias("place", "s")).select("place", "s.key", "s.url")
    good = rows.where((F.coalesce("key", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return good.orderBy("place").limit(limit) if limit else good


def has_prefix(key: Column, prefixes: list[str]) -> Column:
    """Whether a key starts with any prefix; all do if there are none."""
    found = F.lit(not prefixes)
    for p in prefixes:
        found = found | key.startswith(p)
    return found


def key_valid(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY_SHAPE) & ~F.contains(key, F.lit("..")), F.lit(False))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """HTTPS, and the host or one above it is listed."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | host.endswith("." + h)
    return F.coalesce(url.startswith("https://") & listed, F.lit(False))


def status(rows: DataFrame, catalogue: DataFrame, done: DataFrame, hosts: list[str], force: bool = False, dry_run: bool = False) -> DataFrame:
    """key, status of each row: why it is rejected, skipped, only tried, or to be fetched; the first reason counts."""
    known = catalogue.select("key").distinct().withColumn("_known", F.lit(True))
    had = done.select("key").distinct().withColumn("_had", F.lit(True))
    joined = rows.join(known, "key", "left").join(had, "key", "left")
    made = (
        F.when(~key_valid(F.col("key")), "bad_key").when(F.col("_known").isNull(), "unknown_key").when(~host_allowed(F.col("url"), hosts), "host_not_allowed")
        .when(F.col("_had") & F.lit(not force), "skipped").when(F.lit(dry_run), "dry_run").otherwise("fetch")
    )
    return joined.select("key", "url", made.alias("status"))


def pdf_valid(files: DataFrame) -> DataFrame:
    """path, length, ok of binary files: size within bounds and the magic bytes of a PDF."""
    ok = F.col("length").between(MIN_FILE, MAX_FILE) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return files.select("path", "length", ok.alias("ok"))


def report(statuses: DataFrame) -> DataFrame:
    """Rows of each status."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def media_valid(mime: Column, size: Column, seconds: Column) -> Column:
    """Images and videos within their limits; nothing else."""
    image = mime.startswith("image/") & (size <= MAX_IMAGE)
    video = mime.startswith("video/") & (size <= MAX_VIDEO) & (F.coalesce(seconds, F.lit(0)) <= MAX_VIDEO_SECONDS)
    return F.coalesce(image | video, F.lit(False))


def avatar_valid(mime: Column, size: Column) -> Column:
    """Images within the limit of avatars."""
    return F.coalesce(mime.startswith("image/") & (size <= MAX_AVATAR), F.lit(False))


def listed(paths: DataFrame, prefix: str) -> DataFrame:
    """Objects directly or further below a prefix."""
    return paths.where(F.col("path").startswith(prefix))
