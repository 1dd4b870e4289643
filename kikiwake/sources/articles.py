"""Article sources. Payloads of the two listing services are read where they were saved; fetching is an engine hook, not a scan."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import state


def text_or_empty(payload: Column, path: str) -> Column:
    """A JSON string at the path; missing or other values count as empty."""
    raw = F.variant_get(F.try_parse_json(payload), path, "string") if hasattr(F, "variant_get") else F.get_json_object(payload, path)
    return F.coalesce(F.when(F.schema_of_variant(F.variant_get(F.try_parse_json(payload), path, "variant")) == "STRING", raw), F.lit(""))


def count_or_zero(payload: Column, path: str) -> Column:
    """A JSON number at the path, of whole and not negative value, by its lowest 32 bits; anything else counts as 0."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(payload), path, "variant"))
    n = F.when(kind.rlike("^(BIGINT|DECIMAL)"), F.get_json_object(payload, path))
    whole = F.when(n.rlike("^[0-9]{1,20}$"), n.cast("decimal(20,0)"))
    return F.coalesce(F.when(whole < F.lit(str(2**64)).cast("decimal(20,0)"), (whole % F.lit(2**32).cast("decimal(20,0)")).cast("bigint")), F.lit(0).cast("bigint"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Each file one plain article, trusted, not remembered across runs."""
    f = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("id"))
    return f.select("id", F.lit("file").alias("source"), F.col("id").alias("title"), F.lit("").alias("url"), F.lit(0).cast("bigint").alias("popularity"), F.lit("Plain").alias("body_kind"), "body", F.lit(False).alias("dedup"), F.lit(True).alias("trusted"))


def markdown_items(items: DataFrame, n: int, payload: str = "payload", order: str = "seq") -> DataFrame:
    """items(seq, payload) of a listing whose items carry Markdown: at most clamp(n, 1, 100) of them, those without an id left out."""
    top = items.orderBy(order).limit(min(max(n, 1), 100))
    p = F.col(payload)
    rows = top.select(
        order, text_or_empty(p, "$.id").alias("id"), text_or_empty(p, "$.title").alias("title"), text_or_empty(p, "$.url").alias("url"),
        F.greatest(count_or_zero(p, "$.stocks_count"), count_or_zero(p, "$.likes_count")).alias("popularity"), F.lit("Markdown").alias("body_kind"), text_or_empty(p, "$.body").alias("body"),
        F.lit(True).alias("dedup"), F.lit(False).alias("trusted"),
    )
    return rows.where("id <> ''")


def details(listing: DataFrame, archive: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(slug, payload) of the listed items: from the archive, else fetched. ``fetch`` adds ``payload`` to (slug), null where it failed:
    that item is left out, the others stay."""
    slugs = listing.select(text_or_empty(F.col("payload"), "$.slug").alias("slug")).where("slug <> ''").distinct()
    known = state.cached(slugs, archive, "slug", "payload")
    fresh = fetch(known.where("not hit").select("slug")).select("slug", "payload")
    return known.where("hit").select("slug", "payload").unionByName(fresh.where("payload is not null"))


def archived(items: DataFrame, path: str, key: str = "slug") -> bool:
    """Keep payloads that the archive lacks; an archive that can't be written costs nothing but itself."""
    try:
        state.append_absent(items.where(f"{key} is not null and payload is not null").select(key, "payload"), path, key)
    except Exception as e:
        print(f"archive {path}: {e}", file=sys.stderr)
        return False
    return True


def html_items(listing: DataFrame, details: DataFrame, n: int, host: str, order: str = "seq") -> DataFrame:
    """listing(seq, payload) joined with saved details(slug, payload): items without a slug, an article or a body are left out."""
    p, d = F.col("payload"), F.col("detail")
    meta = listing.orderBy(order).limit(max(n, 1)).select(order, text_or_empty(p, "$.slug").alias("id"), text_or_empty(p, "$.title").alias("title"), F.concat(F.lit(host), text_or_empty(p, "$.path")).alias("url"), count_or_zero(p, "$.liked_count").alias("popularity"))
    both = meta.where("id <> ''").join(details.select(F.col("slug").alias("id"), F.col("payload").alias("detail")), "id")
    rows = both.withColumn("body", text_or_empty(d, "$.article.body_html")).where(~is_blank(F.col("body")))
    return rows.select(order, "id", "title", "url", "popularity", F.lit("Html").alias("body_kind"), "body", F.lit(True).alias("dedup"), F.lit(False).alias("trusted"))
