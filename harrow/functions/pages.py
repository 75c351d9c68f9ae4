"""What a page response is: blocked by an anti-bot system, a page without content, redirected, or real.

Every check is one ordered chain of conditions, as the first that holds decides. Size gates count characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions import urls
from harrow.functions.regex import first_label, folded, has, java, let, strip

SMALL_PAGE = 10_240
EMPTY_PAGE, SHELL_PAGE, SHELL_TEXT = 100, 500, 100

# Fixed values: (provider, label, kind of evidence, pattern or names), in order of priority. "cookie" holds cookie names,
# "header" pairs of header name and value pattern (empty: any value).
PROVIDERS = (
    ("cloudflare", "challenge-form with __cf_chl_f_tk", "content", r"(?s)challenge-form.*__cf_chl_f_tk="),
    ("cloudflare", "/cdn-cgi/challenge-platform/*/orchestrate", "content", r"/cdn-cgi/challenge-platform/\S+orchestrate"),
    ("cloudflare", "cf-error-code span", "content", r'<span\s+class="cf-error-code">\d{4}</span>'),
    ("cloudflare", "<title>Just a moment", "content", r"<title>\s*Just\s+a\s+moment"),
    ("cloudflare", "cf-mitigated: challenge header", "header", (("cf-mitigated", "challenge"),)),
    ("cloudflare", "cf_clearance cookie", "cookie", ("cf_clearance",)),
    ("akamai", "Pardon Our Interruption", "content", r"Pardon\s+Our\s+Interruption"),
    ("akamai", "Akamai reference pattern", "content", r"Reference\s*#\s*[\d]+\.[0-9a-f]+\.\d+\.[0-9a-f]+"),
    ("akamai", "_abck cookie", "cookie", ("_abck",)),
    ("perimeterx", "window._pxAppId", "content", r"window\._pxAppId\s*="),
    ("perimeterx", "captcha.px-cdn.net", "content", r"captcha\.px-cdn\.net"),
    ("perimeterx", "x-px-authorization header", "header", (("x-px-authorization", ""),)),
    ("perimeterx", "_px3/_pxhd cookie", "cookie", ("_px3", "_pxhd")),
    ("datadome", "captcha-delivery.com", "content", r"captcha-delivery\.com"),
    ("datadome", "x-dd-b header", "header", (("x-dd-b", ""),)),
    ("datadome", "datadome cookie", "cookie", ("datadome",)),
    ("imperva", "_Incapsula_Resource", "content", r"_Incapsula_Resource"),
    ("imperva", "Incapsula incident ID", "content", r"Incapsula\s+incident\s+ID"),
    ("imperva", "x-cdn: Incapsula or x-iinfo header", "header", (("x-cdn", "Incapsula"), ("x-iinfo", ""))),
    ("kasada", "KPSDK.scriptStart = KPSDK.now()", "content", r"KPSDK\.scriptStart\s*=\s*KPSDK\.now\(\)"),
    ("kasada", "x-kasada header", "header", (("x-kasada", ""),)),
)
# Generic markers on small pages, with their labels; (?i) where case doesn't count.
GENERIC = (
    (r"(?i)Access\s+Denied", "Access Denied"),
    (r"(?i)Checking\s+your\s+browser", "Checking your browser"),
    (r"class=[\"']g-recaptcha[\"']", "reCAPTCHA widget"),
    (r"class=[\"']h-captcha[\"']", "hCaptcha widget"),
    (r"(?i)Access\s+to\s+This\s+Page\s+Has\s+Been\s+Blocked", "Access to This Page Has Been Blocked"),
    (r"(?i)blocked\s+by\s+security", "blocked by security"),
    (r"(?i)Request\s+unsuccessful", "Request unsuccessful"),
)
# Phrases of small pages without content, by category and label, all without regard to case.
NON_CONTENT = (
    ("login", "password input field", r"<input[^>]+type=[\"']password[\"']", None),
    ("login", "login page title with form", r"<title>[^<]*(?:sign\s*in|log\s*in|login)[^<]*</title>", r"<form[\s>]"),
    ("maintenance", "under maintenance", r"under\s+maintenance", None),
    ("maintenance", "maintenance mode", r"maintenance\s+mode", None),
    ("maintenance", "we'll be back", r"we['\x{2019}]ll\s+be\s+(?:right\s+)?back", None),
    ("maintenance", "we will be back", r"we\s+will\s+be\s+(?:right\s+)?back", None),
    ("maintenance", "something went wrong", r"something\s+went\s+wrong", None),
    ("maintenance", "temporarily unavailable", r"temporarily\s+unavailable", None),
    ("maintenance", "scheduled downtime/maintenance", r"scheduled\s+(?:down\s*time|maintenance)", None),
    ("maintenance", "currently unavailable", r"currently\s+unavailable", None),
    ("maintenance", "be right back", r"be\s+right\s+back", None),
    ("maintenance", "experiencing difficulties", r"experiencing\s+(?:technical\s+)?difficulties", None),
    ("maintenance", "under construction", r"under\s+construction", None),
    ("maintenance", "coming soon (in title)", r"<title>[^<]*coming\s+soon[^<]*</title>", None),
    ("maintenance", "coming soon (in h1)", r"<h1[^>]*>[^<]*coming\s+soon[^<]*</h1>", None),
    ("rate_limit", "too many requests", r"too\s+many\s+requests", None),
    ("rate_limit", "rate limit", r"rate\s+limit", None),
    ("rate_limit", "browsing too fast", r"you['\x{2019}]re\s+browsing\s+too\s+fast", None),
    ("rate_limit", "slow down (with request/wait context)", r"slow\s+down", r"request|try\s+again|wait"),
    ("rate_limit", "auto-refresh with wait/try context", r"<meta\s+http-equiv=[\"']refresh[\"']", r"wait|try|moment"),
    ("geo_restriction", "not available in your region", r"not\s+available\s+in\s+your\s+(?:country|region|area|location)", None),
    ("geo_restriction", "geographically restricted", r"geo(?:graphically)?\s*restrict", None),
    ("geo_restriction", "regional restriction", r"region(?:al)?\s+restriction", None),
    ("geo_restriction", "blocked in your region", r"blocked\s+in\s+your\s+(?:country|region)", None),
    ("geo_restriction", "not accessible from your location", r"not\s+accessible\s+from\s+your\s+location", None),
    ("suspended", "account suspended/banned", r"account\s+(?:has\s+been\s+)?(?:suspended|banned|disabled|terminated)", None),
    ("suspended", "IP blocked/banned", r"(?:ip|address)\s+(?:has\s+been\s+)?(?:blocked|banned)", None),
)
CONTENT_TAGS = r"<(?:p|h[1-6]|article)[\s>]"


def visible_text(html: Column) -> Column:
    """html without script and style blocks and tags, white space collapsed."""
    bare = F.regexp_replace(html, java(r"<(script|style)[^>]*>.*?</\1>", "si"), "")
    return strip(F.regexp_replace(F.regexp_replace(bare, java("<[^>]+>"), ""), java(r"[\s\x1c-\x1f]+"), " "))


def detect_antibot(content: Column, headers: Column | None = None, cookies: Column | None = None) -> Column:
    """struct<provider, tier, pattern>, or null for a clean page.

    headers is a map by name in any case, cookies an array of maps with a name; both may be left out or null."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k)) if headers is not None else None
    jar = F.transform(cookies, lambda c: c["name"]) if cookies is not None else None
    found = lambda provider, tier, pattern: F.struct(F.lit(provider).cast("string").alias("provider"), F.lit(tier).alias("tier"), pattern.alias("pattern"))

    def evidence(kind: str, what) -> Column:
        if kind == "content":
            return has(content, what)
        if kind == "cookie":
            return F.coalesce(F.arrays_overlap(jar, F.array(*map(F.lit, what))), F.lit(False)) if jar is not None else F.lit(False)
        if low is None:
            return F.lit(False)
        told = F.lit(False)
        for name, value in what:
            told = told | (has(F.try_element_at(low, F.lit(name)), value, "i") if value else F.coalesce(F.map_contains_key(low, name), F.lit(False)))
        return told

    chain = []
    if low is not None:
        chain.append(F.when(F.coalesce(F.map_contains_key(low, "x-amzn-waf-action"), F.lit(False)), found("aws_waf", 1, F.lit("x-amzn-waf-action header"))))
    there = content.isNotNull()
    chain += [F.when(there & evidence(kind, what), found(provider, 1, F.lit(label))) for provider, label, kind, what in PROVIDERS if kind == "content" or (low if kind == "header" else jar) is not None]
    generic = lambda s: F.coalesce(*[F.when(has(s["text"], pattern, by=s), found(None, 2, F.lit(label))) for pattern, label in GENERIC])
    chain.append(F.when(F.length(content) < SMALL_PAGE, let(folded(content), generic)))
    size, bare = F.length(content), ~has(content, CONTENT_TAGS, "i")
    chain.append(F.when((size < EMPTY_PAGE) & bare, found(None, 3, F.format_string("effectively empty (%d bytes)", size))))
    chain.append(F.when((size < SHELL_PAGE) & bare, found(None, 3, F.format_string("empty shell (%d bytes, no content tags)", size))))
    shown = F.length(visible_text(content))
    chain.append(F.when(has(content, r"<script[\s>]", "i") & bare & (shown < SHELL_TEXT), found(None, 3, F.format_string("script-only shell (%d visible chars, no content tags)", shown))))
    return F.coalesce(*chain)


def detect_non_content(content: Column) -> Column:
    """struct<category, pattern> of a small page that is a login wall, a notice or a refusal; else null."""

    def judged(s: Column) -> Column:
        chain = []
        for category, label, pattern, context in NON_CONTENT:
            told = has(s["text"], pattern, "i", s)
            if context:
                told = told & has(s["text"], context, "i")
            chain.append(F.when(told, F.struct(F.lit(category).alias("category"), F.lit(label).alias("pattern"))))
        return F.coalesce(*chain)

    return F.when(F.length(content) < SMALL_PAGE, let(folded(content), judged))


def verify_page(status: Column, page_url: Column, content: Column, headers: Column | None, cookies: Column | None, target_url: Column) -> Column:
    """no_response, server_error, redirected, anti_bot, soft_block or real_page."""
    return (
        F.when(status.isNull() & page_url.isNull(), "no_response")
        .when(F.coalesce((status >= 500) | (status == 429), F.lit(False)), "server_error")
        .when(page_url.isNotNull() & (F.coalesce(target_url, F.lit("")) != "") & ~urls.domains_match(page_url, target_url), "redirected")
        .when(detect_antibot(content, headers, cookies).isNotNull(), "anti_bot")
        .when(detect_non_content(content).isNotNull(), "soft_block")
        .otherwise("real_page")
    )


def generic_marker(content: Column) -> Column:
    """The first generic marker on a page of any size."""
    return first_label(content, GENERIC)
