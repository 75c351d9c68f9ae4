"""URL functions that tolerate any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.regex import grab, java, strip

# Names of tracking, session and cache-buster parameters, and their prefixes.
NOISE_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "ttclid",
    "ref", "referer", "referrer", "source",
    "sid", "session", "session_id", "sessionid", "ssid", "token", "csrf", "csrf_token", "csrftoken", "nonce", "auth", "auth_token",
    "_", "timestamp", "ts", "cb", "t", "v", "ver",
)
NOISE_PREFIXES = ("utm_", "fb_", "_ga", "__", "pk_")


def scheme(url: Column) -> Column:
    return F.lower(F.coalesce(grab(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"), F.lit("")))


def authority(url: Column) -> Column:
    """What stands between // and the path, without user data."""
    return F.regexp_replace(F.coalesce(grab(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"), F.lit("")), "^.*@", "")


def host(url: Column) -> Column:
    """Host name in lower case without a leading www.; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_replace(authority(url), r":\d*$", "")), r"^www\.", "")


def port(url: Column) -> Column:
    """The explicit port, or null."""
    return grab(authority(url), r":(\d+)$").try_cast("int")


def default_port(of_scheme: Column) -> Column:
    return F.when(of_scheme == "https", 443).when(of_scheme == "http", 80)


def domains_match(page: Column, target: Column) -> Column:
    """Same host; same port where one is explicit. Pages of data:, blob: and about: never match."""
    ports = F.coalesce(port(page), default_port(scheme(page))).eqNullSafe(F.coalesce(port(target), default_port(scheme(target))))
    same = ~scheme(page).isin("data", "blob", "about") & (host(page) != "") & (host(page) == host(target))
    return F.coalesce(same & ((port(page).isNull() & port(target).isNull()) | ports), F.lit(False))


def is_valid(url: Column) -> Column:
    """An http or https URL with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != ""), F.lit(False))


def query_pairs(url: Column) -> Column:
    """array<struct<key, value>> of the decoded query, and of the query in a #/path?query fragment; blank values are dropped."""
    plain = F.coalesce(grab(url, r"^[^?#]*\?([^#]*)"), F.lit(""))
    fragment = F.coalesce(grab(url, r"#[^?]*\?(.*)$", 1, "s"), F.lit(""))
    decode = lambda x: F.coalesce(F.call_function("try_url_decode", x), x)
    parts = F.filter(F.split(F.concat_ws("&", plain, fragment), "&"), lambda p: p.rlike("^[^=]*=.+"))
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))


def param_class(key: Column, values: Column) -> Column:
    """noise, complex or clean, for a query parameter and its (decoded) values in order."""
    name = F.lower(key)
    noise = name.isin(*NOISE_PARAMS)
    for prefix in NOISE_PREFIXES:
        noise = noise | name.startswith(prefix)
    count = lambda v, kind: F.length(v) - F.length(F.regexp_replace(v, kind, ""))

    def one(v: Column) -> Column:
        digits, letters = count(v, java(r"\p{Nd}")), count(v, java(r"\p{L}"))
        return F.when(strip(v).rlike(r"^[{\[]") & (F.length(strip(v)) > 50), "complex").when(
            (F.length(v) > 24) & (digits > 0) & (letters > 0) & ((digits + letters) / F.length(v) > 0.85), "noise"
        )

    told = F.filter(F.transform(values, one), lambda x: x.isNotNull())
    return F.when(noise, "noise").otherwise(F.coalesce(F.try_element_at(told, F.lit(1)), F.lit("clean")))
