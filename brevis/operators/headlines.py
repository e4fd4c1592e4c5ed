"""Headline pages: extraction, cleaning, time stamps."""

from pyspark.sql import DataFrame, functions as F

from brevis import constants as K
from brevis.functions import text as T
from brevis.functions.scale import unfold
from brevis.operators.filters import blacklist_filter


def _inner(html, tag: str, css_class: str | None):
    attrs = rf"[^>]*class=[\"']{css_class}[\"'][^>]*" if css_class else r"(?:\s[^>]*)?"
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}{attrs}>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "<[^>]*>", ""))


def extract_headlines(pages: DataFrame, tag: str = "h3") -> DataFrame:
    """page_id, pos, headline: the text of every such element, in page order."""
    return unfold(pages, ["page_id"], _inner(F.col("html"), tag, None), "pos", "headline")


def extract_timestamps(pages: DataFrame, tag: str = "span", css_class: str = "article__timestamp") -> DataFrame:
    return unfold(pages, ["page_id"], _inner(F.col("html"), tag, css_class), "pos", "stamp")


def zip_columns(pages: DataFrame, first: str, second: str) -> DataFrame:
    """Two element lists of a page paired by place."""
    both = F.arrays_zip(_inner(F.col("html"), first, None).alias("first"), _inner(F.col("html"), second, None).alias("second"))
    paired = unfold(pages, ["page_id"], both, "pos", "_p")
    return paired.select("page_id", "pos", F.col("_p.first").alias("first"), F.col("_p.second").alias("second"))


def clean_headline(df: DataFrame, column: str = "headline") -> DataFrame:
    """Drop newlines and boilerplate, strip, delete . ? : , write percent out, lower-case, drop boilerplate."""
    bare = df.withColumn(column, F.replace(F.col(column), F.lit("\n"), F.lit("")))
    kept = blacklist_filter(bare, K.BOILERPLATE_RAW, column)
    plain = F.translate(F.trim(F.col(column)), ".?:,", "")
    named = F.lower(F.replace(plain, F.lit("%"), F.lit("percent")))
    return blacklist_filter(kept.withColumn(column, named), K.BOILERPLATE_CLEAN, column)


def clean_timestamp(df: DataFrame, column: str = "stamp") -> DataFrame:
    """Delete the zone mark, the word "at", am/pm marks, commas and full stops."""
    return df.withColumn(column, F.regexp_replace(F.col(column), r"ET|at|p\.m\.|a\.m\.|,|\.", ""))


def parse_timestamp(df: DataFrame, column: str = "stamp", faithful: bool = False) -> DataFrame:
    """Time stamps such as "Feb. 3, 2022 at 4:05 p.m. ET" to ``ts``.

    The half of the day is honoured; ``faithful`` reads every hour as a morning hour.
    """
    marked = F.col(column)
    if not faithful:
        marked = F.regexp_replace(F.regexp_replace(marked, r"p\.m\.", "PM"), r"a\.m\.", "AM")
    bare = T.squash(F.regexp_replace(marked, r"ET|at|p\.m\.|a\.m\.|,|\.", ""))
    if faithful:
        bare = F.concat(bare, F.lit(" AM"))
    return df.withColumn("ts", F.try_to_timestamp(bare, F.lit("MMM d yyyy h:mm a")))
