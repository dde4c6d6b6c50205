"""Breadth-first discovery over a menu, one frontier at a time."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dates import parse_date
from ..functions.text import breadcrumb, safe_filename, safe_path


def page_links(pages: DataFrame) -> DataFrame:
    """pages (url, html) to url, link_ord, target, label, kind (document, menu, other), menu_id."""
    each = pages.select("url", F.posexplode(urls.links(F.col("html"))).alias("link_ord", "l"))
    out = each.select("url", "link_ord", urls.resolved(F.col("url"), F.col("l.href")).alias("target"), F.col("l.text").alias("label"))
    menu = F.when(F.contains("target", F.lit(urls.MENU_PAGE)), urls.menu_id(F.col("target")))
    kind = F.when(urls.is_document_link(F.col("target")), "document").when(menu.isNotNull(), "menu").otherwise("other")
    return out.withColumn("kind", kind).withColumn("menu_id", F.when(kind == "menu", menu))


def crawl_pages(pages: DataFrame, root_url: str, most_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Menu nodes (id, url, crumb, level, node_ord) and documents (source_url, title, section_path, menu_id, discovery_ord).

    Each level is one frontier: its pages' in-scope menu links that were not
    visited, the first discovery of each counting.  The first discovery of a
    document counts.  A page that is missing or null has no links.  The crawl
    ends with an empty frontier; one deeper than most_levels is an error.
    """
    spark = pages.sparkSession
    root = spark.range(1).select(urls.menu_id(F.lit(root_url)).alias("m")).first()["m"] or "root"
    links = page_links(pages.where("html is not null")).where("kind <> 'other'").persist()  # read once for each level
    titles = pages.select("url", urls.page_title(F.col("html"), F.lit(root)).alias("own_title"))
    frontier = spark.createDataFrame([(root, root_url, "")], "id string, url string, path string").join(titles, "url", "left").select("id", "url", F.coalesce("own_title", F.lit(f"section-{root}")).alias("crumb"), F.lit(0).alias("level"), F.lit("").alias("ord"))
    visited = frontier
    for level in itertools.count(1):
        menu = frontier.select("url", "crumb", "ord").join(links.where("kind = 'menu'"), "url").where(urls.in_scope(F.col("menu_id"), root))
        found = menu.select(F.col("menu_id").alias("id"), F.col("target").alias("url"), breadcrumb(F.col("crumb"), F.col("label"), F.col("menu_id")).alias("crumb"), F.lit(level).alias("level"), F.concat("ord", F.format_string("/%06d", F.col("link_ord"))).alias("ord"))
        found = found.join(visited.select("id"), "id", "left_anti")
        first = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("n = 1").drop("n")
        frontier = cut(first)  # each level's plan would hold those of all levels before it twice
        if frontier.isEmpty():
            break
        if most_levels is not None and level > most_levels:
            raise ValueError(f"menu deeper than {most_levels} levels")
        visited = visited.unionByName(frontier)
    docs = visited.join(links.where("kind = 'document'"), "url").select(F.col("target").alias("source_url"), F.col("label").alias("title"), F.col("crumb").alias("section_path"), F.col("id").alias("menu_id"), F.struct("level", "ord", "link_ord").alias("discovery_ord"))
    docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("source_url").orderBy("discovery_ord"))).where("n = 1").drop("n")
    return visited.select("id", "url", "crumb", "level", F.col("ord").alias("node_ord")), docs


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clausebase-"))
    return df.checkpoint()


def download_records(docs: DataFrame, docs_dir: str, date_text: str | None = None) -> DataFrame:
    """Index records of discovered documents: ids, types, dates and file names; the download's columns are null."""
    kind = urls.doc_type(F.col("source_url"))
    own = F.sha1(F.col("source_url").cast("binary"))
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_extract(urls.url_path(F.col("source_url")), r"([^/]*)$", 1))
    raw = F.col(date_text) if date_text else F.lit(None).cast("string")
    out = docs.withColumns({"title": name, "doc_id": own, "doc_type": kind, "date_raw": raw})
    path = F.concat(F.lit(docs_dir.rstrip("/") + "/"), safe_path(F.col("section_path")), F.lit("/"), safe_filename(F.col("title"), F.col("doc_id"), F.col("doc_type")))
    return out.withColumns({"date_parsed": parse_date(F.col("date_raw")), "local_path": path})


def crawl_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("download_ok")).alias("ok"), F.count_if(~F.coalesce("download_ok", F.lit(False))).alias("failed"))
