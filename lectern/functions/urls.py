"""URL and id column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_url(url: Column, doi: Column, external_id: Column) -> Column:
    """Url, else https://doi.org/<doi without doi.org prefix>, else an http external_id."""
    u = F.coalesce(url, F.lit(""))
    d = F.coalesce(doi, F.lit(""))
    e = F.coalesce(external_id, F.lit(""))
    clean = F.replace(F.replace(d, F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))
    return (F.when(u != "", u)
            .when(d != "", F.concat(F.lit("https://doi.org/"), clean))
            .when(e.startswith("http"), e)
            .otherwise(F.lit("")))


def record_id(source_type: Column, name: Column, url: Column) -> Column:
    """source_type ':' first 16 hex of md5(name ':' url)."""
    return F.concat(source_type, F.lit(":"),
                    F.substring(F.md5(F.concat(name, F.lit(":"), url)), 1, 16))


def raw_id(name: Column, raw: Column) -> Column:
    """T22 (fixed): stable fallback id name ':' sha256(raw payload)."""
    return F.concat(name, F.lit(":"), F.sha2(raw, 256))


def absolute_url(base: Column, url: Column) -> Column:
    """Resolve url against base (absolute, //host, /path, ?query, #frag, relative path).

    Matches urllib's urljoin on the cases a scraper meets; dot segments ('./', up
    to four '../') are resolved inside the path, never into the host.
    """
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    path = F.regexp_extract(no_query, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/.*)?$", 1)
    dir_path = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    # resolve dot segments inside the path only (never into the host)
    p = F.concat(dir_path, url)
    for _ in range(2):
        p = F.regexp_replace(p, r"/\./", "/")
    for _ in range(4):
        p = F.regexp_replace(p, r"/(?!\.\./)[^/?#]+/\.\./", "/")
    p = F.regexp_replace(p, r"^(/\.\.)+/", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/(?!\.\.$)[^/?#]+/\.\.$", "/"), r"/\.$", "/")
    rel = F.concat(origin, p)
    return (F.when(url.isNull() | (url == ""), url)
            .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
            .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
            .when(url.startswith("/"), F.concat(origin, url))
            .when(url.startswith("?"), F.concat(no_query, url))
            .when(url.startswith("#"), F.concat(no_frag, url))
            .otherwise(rel))


def pages_range(first: Column, last: Column) -> Column:
    """T36: 'first-last', or first alone."""
    return F.when(F.coalesce(last, F.lit("")) != "", F.concat_ws("-", first, last)).otherwise(first)


def pagination_template(url: Column) -> Column:
    """T29 (URL part): a page=/p= parameter becomes a {page} template; else null."""
    return (F.when(url.rlike(r"[?&]page=\d+"), F.regexp_replace(url, r"([?&]page=)\d+", "$1{page}"))
            .when(url.rlike(r"[?&]p=\d+"), F.regexp_replace(url, r"([?&]p=)\d+", "$1{page}")))
