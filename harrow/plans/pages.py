"""Queries on pages and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import pages as verdicts
from harrow.functions import urls
from harrow.operators import pages
from harrow.sources.tables import table

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), ':\d*$', ''), '^www\.', '')"
#: What the checks look for, as SQL states it, apart from the library's own tables.
_SOFT = r"""
WHEN regexp_matches(html, '(?i)<input[^>]+type=["'']password["'']') OR (regexp_matches(html, '(?i)<title>[^<]*(sign\s*in|log\s*in|login)[^<]*</title>') AND regexp_matches(html, '(?i)<form[\s>]')) THEN 'login'
WHEN regexp_matches(html, '(?i)under\s+maintenance|maintenance\s+mode|we[''’]ll\s+be\s+(right\s+)?back|we\s+will\s+be\s+(right\s+)?back|something\s+went\s+wrong|temporarily\s+unavailable|scheduled\s+(down\s*time|maintenance)|currently\s+unavailable|be\s+right\s+back|experiencing\s+(technical\s+)?difficulties|under\s+construction|<title>[^<]*coming\s+soon[^<]*</title>|<h1[^>]*>[^<]*coming\s+soon[^<]*</h1>') THEN 'maintenance'
WHEN regexp_matches(html, '(?i)too\s+many\s+requests|rate\s+limit|you[''’]re\s+browsing\s+too\s+fast') OR (regexp_matches(html, '(?i)slow\s+down') AND regexp_matches(html, '(?i)request|try\s+again|wait'))
  OR (regexp_matches(html, '(?i)<meta\s+http-equiv=["'']refresh["'']') AND regexp_matches(html, '(?i)wait|try|moment')) THEN 'rate_limit'
WHEN regexp_matches(html, '(?i)not\s+available\s+in\s+your\s+(country|region|area|location)|geo(graphically)?\s*restrict|region(al)?\s+restriction|blocked\s+in\s+your\s+(country|region)|not\s+accessible\s+from\s+your\s+location') THEN 'geo_restriction'
WHEN regexp_matches(html, '(?i)account\s+(has\s+been\s+)?(suspended|banned|disabled|terminated)|(ip|address)\s+(has\s+been\s+)?(blocked|banned)') THEN 'suspended'
"""
_TIER1 = r"""regexp_matches(html, '(?s)challenge-form.*__cf_chl_f_tk=') OR regexp_matches(html, '/cdn-cgi/challenge-platform/\S+orchestrate|<span\s+class="cf-error-code">\d{4}</span>|<title>\s*Just\s+a\s+moment')
  OR regexp_matches(html, 'Pardon\s+Our\s+Interruption|Reference\s*#\s*\d+\.[0-9a-f]+\.\d+\.[0-9a-f]+|window\._pxAppId\s*=|captcha\.px-cdn\.net|captcha-delivery\.com')
  OR regexp_matches(html, '_Incapsula_Resource|Incapsula\s+incident\s+ID|KPSDK\.scriptStart\s*=\s*KPSDK\.now\(\)')"""
_TIER2 = r"""regexp_matches(html, '(?i)Access\s+Denied|Checking\s+your\s+browser|Access\s+to\s+This\s+Page\s+Has\s+Been\s+Blocked|blocked\s+by\s+security|Request\s+unsuccessful')
  OR regexp_matches(html, 'class=["''](g-recaptcha|h-captcha)["'']')"""
_BARE = r"NOT regexp_matches(html, '(?i)<(?:p|h[1-6]|article)[\s>]')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_TIER = rf"""CASE WHEN {_TIER1} THEN 1 WHEN length(html) < 10240 AND ({_TIER2}) THEN 2 WHEN length(html) < 500 AND {_BARE} THEN 3
  WHEN regexp_matches(html, '(?i)<script[\s>]') AND {_BARE} AND length({_VISIBLE}) < 100 THEN 3 END"""


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and verdict, each held against its own address."""
    df = table(spark, sf_dir, "pages")
    verdict = verdicts.verify_page(F.lit(200), F.col("url"), F.col("html"), None, None, F.col("url"))
    return df.select(urls.host(F.col("url")).alias("host"), verdict.alias("verdict")).groupBy("host", "verdict").agg(F.count("*").alias("n"))


VERDICTS_SQL = f"""
SELECT {_HOST} AS host, CASE WHEN {_HOST} = '' THEN 'redirected' WHEN {_TIER} IS NOT NULL THEN 'anti_bot' WHEN length(html) < 10240 AND (CASE {_SOFT} END) IS NOT NULL THEN 'soft_block' ELSE 'real_page' END AS verdict,
  count(*) AS n FROM pages GROUP BY ALL
"""


def antibot_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the tier at which they look blocked."""
    tier = verdicts.detect_antibot(F.col("html"))["tier"]
    return table(spark, sf_dir, "pages").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


TIERS_SQL = f"SELECT {_TIER} AS tier, count(*) AS n FROM pages GROUP BY ALL"


def soft_block_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages by what they are instead of content."""
    category = verdicts.detect_non_content(F.col("html"))["category"]
    return table(spark, sf_dir, "pages").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


SOFT_SQL = f"SELECT CASE WHEN length(html) < 10240 THEN CASE {_SOFT} END END AS category, count(*) AS n FROM pages GROUP BY ALL"


def visible_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each page's visible text."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(verdicts.visible_text(F.col("html"))).alias("n_chars"))


VISIBLE_SQL = f"SELECT page_id, CAST(length({_VISIBLE}) AS INTEGER) AS n_chars FROM pages"


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host."""
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


HOST_SQL = f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY ALL"


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query parameters of addresses: (page_id, key, value)."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.query_pairs(F.col("url"))).alias("p")).select("page_id", "p.key", "p.value")


_PARAMS = r"""
SELECT page_id, split_part(p, '=', 1) AS key, url_decode(replace(regexp_replace(p, '^[^=]*=', ''), '+', ' ')) AS value FROM (
  SELECT page_id, unnest(string_split(concat_ws('&', regexp_extract(url, '^[^?#]*\?([^#]*)', 1), regexp_extract(url, '#[^?]*\?(.*)$', 1)), '&')) AS p FROM pages
) WHERE regexp_matches(p, '^[^=]*=.+')
"""


def url_param_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parameters of addresses are clean, complex or noise, by name."""
    params = url_params(spark, sf_dir).groupBy("page_id", "key").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return params.groupBy("key", urls.param_class(F.col("key"), F.col("values")).alias("class")).agg(F.count("*").alias("n"))


_NOISE = ", ".join(f"'{p}'" for p in urls.NOISE_PARAMS)
CLASSES_SQL = rf"""
SELECT key, CASE WHEN lower(key) IN ({_NOISE}) OR {" OR ".join(f"starts_with(lower(key), '{p}')" for p in urls.NOISE_PREFIXES)} THEN 'noise' ELSE 'clean' END AS class, count(*) AS n
FROM (SELECT DISTINCT page_id, key FROM ({_PARAMS})) GROUP BY ALL
"""


def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pages by tag."""
    return pages.node_table(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible nodes by tag."""
    return pages.visible_nodes(pages.node_table(table(spark, sf_dir, "pages"))).groupBy("tag").agg(F.count("*").alias("n"))


def repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three or more equal siblings."""
    return pages.repeated_groups(pages.node_table(table(spark, sf_dir, "pages")))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every page."""
    return pages.page_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page."""
    return pages.section_lines(pages.page_sections(table(spark, sf_dir, "pages")))


def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by role."""
    return pages.page_sections(table(spark, sf_dir, "pages")).groupBy("semantic_role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a list of its sections."""
    df = table(spark, sf_dir, "pages")
    return pages.page_view(pages.page_sections(df), df)


def zoom_first_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page zoomed to its first section."""
    df = table(spark, sf_dir, "pages")
    rows = pages.page_sections(df)
    return pages.zoomed(df, rows, rows.where("pos = 0"))


def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page cleaned."""
    return pages.cleaned(table(spark, sf_dir, "pages"))


def interactive_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactive elements that the HTML tells of."""
    return pages.element_lines(pages.interactive_elements(table(spark, sf_dir, "pages")))


QUERIES = {
    f.__name__: f
    for f in (
        page_verdicts, antibot_tiers, soft_block_categories, visible_text_len, url_host, url_params, url_param_classes, dom_nodes, visible_nodes, repeated_groups, html_text, page_sections,
        section_roles, page_views, zoom_first_section, sanitize_html, interactive_static,
    )
}
SQL = {
    "page_verdicts": VERDICTS_SQL, "antibot_tiers": TIERS_SQL, "soft_block_categories": SOFT_SQL, "visible_text_len": VISIBLE_SQL, "url_host": HOST_SQL, "url_params": _PARAMS,
    "url_param_classes": CLASSES_SQL,
}
