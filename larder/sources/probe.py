"""What stored pages tell of a site: links to guides, platforms, pictures and the way to its label.

Pages have ``url``, ``html`` and a column of order; a site is the host of the url, without www.
A null or empty page did not open. Repeated pages count once; urls without a host are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources import html as pages_html

GUIDE = r"(?i)\.pdf($|[?#])"
ABOUT = r"(?i)nutrition|allerg"
IMAGE = r"(?i)https://[^\"'\\ )]+?\.(?:jpg|jpeg|png|webp)"
#: Words of addresses that aren't pictures of products.
JUNK = r"(?i)logo|icon|sprite|favicon|placeholder|banner|hero|badge|social"
LABEL = r"NutritionInformation|\"(?:calories|kcal)\""
API = r"(?i)graphql|/api/(?:menu|products|nutrition)"
SHELL = 15 * 1024  # shorter pages are shells that a script fills
MANY_IMAGES = 20


def site(url: Column) -> Column:
    """Host of a url in lower case, without www; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def _resolved(href: Column, url: Column) -> Column:
    """Absolute address of a link: with a scheme, from the host, or beside the page."""
    origin = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/(?:[^?#]*/)?)", 1)
    return (F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, "^([A-Za-z]+:)", 1), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href)))


def _guides(html: Column, url: Column, ending: str, about: str) -> Column:
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    fit = F.filter(hrefs, lambda h: F.regexp_like(h, F.lit(ending)) & F.regexp_like(h, F.lit(about)))
    return F.array_distinct(F.transform(fit, lambda h: _resolved(h, url)))


def guide_links(pages: DataFrame, order: str, ending: str = GUIDE, about: str = ABOUT) -> DataFrame:
    """site, order, place and guide of the links to guides; each site's first page that has any gives all of them.

    One page a site survives the partial aggregation, so only found links are shuffled.
    """
    found = pages.select(site(F.col("url")).alias("site"), F.col(order), _guides(F.coalesce("html", F.lit("")), F.col("url"), ending, about).alias("guides"))
    first = found.where("site IS NOT NULL AND size(guides) > 0").groupBy("site").agg(F.min(F.struct(order, "guides")).alias("first"))
    return first.select("site", f"first.{order}", F.posexplode("first.guides").alias("place", "guide"))


def readable_guides(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` that really are PDF: by their first bytes, whatever the address says."""
    return files.where(F.substring(F.col(content), 1, 4) == F.lit(b"%PDF"))


def images(html: Column) -> Column:
    """Number of distinct pictures in a page, without their queries and without marks of the site."""
    found = F.filter(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), lambda u: ~F.regexp_like(u, F.lit(JUNK)))
    return F.size(F.array_distinct(found))


def site_routes(pages: DataFrame, order: str) -> DataFrame:
    """site, order of the page that decides, kind, images and in_shell of every site.

    The first page that opened decides by its best sign: guide (linked), label (in the markup), api,
    linked (own links, no label) or rendered. Without one a wall makes the site blocked, which goes
    before unknown: a site that doesn't let in isn't a wrong address.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    host = site(F.col("url"))
    own = F.exists(F.regexp_extract_all(html, F.lit(r"href=\"(/[^\"/?#][^\"]*)\""), F.lit(1)), lambda h: F.length(h) > 1)
    kind = (F.when(F.trim(html) == "", "unknown").when(pages_html.is_wall(html), "blocked")
            .when(F.size(_guides(html, F.col("url"), GUIDE, ABOUT)) > 0, "guide").when(F.regexp_like(html, F.lit(LABEL)), "label")
            .when(F.regexp_like(html, F.lit(API)), "api").when(own, "linked").otherwise("rendered"))
    told = pages.select(host.alias("site"), F.col(order), kind.alias("kind"), images(html).alias("images"), (F.length(html) < SHELL).alias("in_shell")).where("site IS NOT NULL")
    rank = F.when(F.col("kind") == "unknown", 2).when(F.col("kind") == "blocked", 1).otherwise(0)
    best = told.groupBy("site").agg(F.min(F.struct(rank.alias("rank"), order, "kind", "images", "in_shell")).alias("best"))
    return best.select("site", f"best.{order}", "best.kind", "best.images", "best.in_shell")
