"""Line dedup by site-relative frequency, in DataFrame functions only.

For every site, the pages that contain a line are divided by the site's pages;
lines above a boilerplate ratio are dropped from all of the site's pages.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeykit.llm.storage import saved, small_side


def line_keys(text: Column) -> Column:
    """Hashes of the distinct lines of a text that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate_lines(docs: DataFrame, text_col: str, site_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``(site, lines)``: hashes of each site's boilerplate lines; sites without any have no row.

    Pages of a site with equal texts count as one page, so copies of a page do
    not turn its own lines into boilerplate; this also pre-aggregates hot
    copies before anything is shuffled. A site's list is bounded by its mean
    number of lines a page divided by ``max_ratio``.
    """
    pages = (docs.where(F.col(text_col).isNotNull())
             .select(F.col(site_col).alias("site"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n"),
                     line_keys(F.col(text_col)).alias("lines"))
             .groupBy("site", "h", "n").agg(F.first("lines").alias("lines")))
    marked = pages.select("site", F.explode(F.concat(F.array(F.lit(None).cast("long")), "lines")).alias("line"))
    # The row with a null line counts the site's pages; of the lines only the frequent ones go on.
    counts = saved(marked.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"))
                   .where(F.col("line").isNull() | (F.col("pages") >= min_pages)), "line-counts")
    total = counts.where("line is null").select(F.col("site").alias("of"), F.col("pages").alias("total"))
    over = (counts.where("line is not null").join(total, F.col("site").eqNullSafe(F.col("of")))
            .where(F.col("pages") / F.col("total") > F.lit(max_ratio)))
    return over.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", max_ratio: float = 0.01,
                           min_pages: int = 3) -> DataFrame:
    """``docs`` with the text's boilerplate lines dropped, and two columns more:
    ``n_lines`` and ``n_dropped`` (columns of those names are replaced).

    A line (text between newlines, compared as it is) is boilerplate on a site
    if more than ``max_ratio`` of the site's pages contain it, and at least
    ``min_pages`` pages do: a line that one page in a hundred repeats was put
    there by the site, and few pages may repeat one by chance. Every occurrence
    goes, also repeated ones within a page. Blank lines never count and stay. A null site is a site of its own.
    A null text stays null with no lines; an empty text has one line. No row
    goes: a text may become empty. An empty table gives an empty result.
    """
    bad = saved(boilerplate_lines(docs, text_col, site_col, max_ratio, min_pages), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0))).first()[0]
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    rows = rows.join(small_side(bad, size), F.col(f"doc.`{site_col}`").eqNullSafe(F.col("site")), "left")
    text = F.col(f"doc.`{text_col}`")
    rows = rows.select("doc", F.when(F.col("lines").isNotNull() & text.isNotNull(),
                                     F.array_intersect(line_keys(text), "lines")).alias("hit"))
    dirty = F.coalesce(F.size("hit") > 0, F.lit(False))
    rows = rows.select("doc", F.when(dirty, F.filter(F.split(text, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(
        F.col("hit"), F.xxhash64(x)))).alias("rest"))
    n_lines = F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).cast("bigint")
    clean = F.when(F.col("rest").isNull(), text).otherwise(F.array_join("rest", "\n"))
    dropped = F.coalesce(n_lines - F.size("rest"), F.lit(0)).cast("bigint")
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in names],
                       n_lines.alias("n_lines"), F.when(F.col("rest").isNull(), F.lit(0)).otherwise(dropped)
                       .cast("bigint").alias("n_dropped"))
