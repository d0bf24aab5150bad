"""URL identity and story slugs.

The standard library's rules for URLs (international names, percent-encoding,
form queries) can't be expressed with Spark's URL functions, so one Arrow UDF
derives everything at once; it is meant for rows that passed the theme filter.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track readers, and their common prefix.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "vero_conv", "vero_id"]
TRACKING_PREFIX = "utm_"
#: Slug words that say nothing about a story.
GENERIC = ["article", "index", "news", "story", "update", "latest"]
FEWEST_SLUG_WORDS = 5
#: Page suffixes that a slug doesn't keep.
PAGE_SUFFIXES = (".html", ".htm", ".aspx", ".asp", ".php")
_PORTS = {"http": (None, 0, 80), "https": (None, 0, 443)}
_TELLING = re.compile("[a-z0-9]*[a-z][a-z0-9]*")
IDENTITY = "canonical_url string, source_domain string, slug string"


class Address(NamedTuple):
    """What identifies a page: everything that only says how a reader came there is gone."""

    scheme: str
    host: str
    port: str
    segments: tuple[str, ...]
    query: str

    def __str__(self) -> str:
        return f"{self.scheme}://{self.host}{self.port}/{'/'.join(self.segments)}" + ("?" + self.query if self.query else "")

    @property
    def domain(self) -> str | None:
        return self.host.partition(":")[0] or None

    @property
    def slug(self) -> str | None:
        """The telling words of the last path segment, if there are enough."""
        title = unquote(self.segments[-1]).lower() if self.segments else ""
        for suffix in PAGE_SUFFIXES:
            if title.endswith(suffix):
                title = title.removesuffix(suffix)
                break
        words = [w for w in _TELLING.findall(title) if w not in GENERIC]
        return "-".join(words) if len(words) >= FEWEST_SLUG_WORDS else None


def address(raw: str | None) -> Address | None:
    """The address of an http(s) URL, None for anything else; bad hosts and ports raise ValueError."""
    u = urlsplit((raw or "").strip())
    free = _PORTS.get(u.scheme)
    if free is None or not u.hostname:
        return None
    pairs = [(k.lower(), v, k) for k, v in parse_qsl(u.query, keep_blank_values=True)]
    telling = [x for x in pairs if x[0] not in TRACKING and not x[0].startswith(TRACKING_PREFIX)]
    query = urlencode([(k, v) for _, v, k in sorted(telling, key=lambda x: x[:2])])
    return Address(u.scheme, str(u.hostname.encode("idna"), "ascii").lower(), "" if u.port in free else f":{u.port}", tuple(filter(None, u.path.split("/"))), query)


def identity(raw: str | None) -> tuple[str | None, str | None, str | None]:
    """(canonical URL, its domain, its slug), all None if it isn't a URL."""
    try:
        found = address(raw)
    except ValueError:
        found = None
    return (str(found), found.domain, found.slug) if found else (None, None, None)


def _identity(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([identity(None if x is None else str(x)) for x in raw], columns=["canonical_url", "source_domain", "slug"], dtype=object)


def url_identity(raw: Column | str) -> Column:
    """struct<canonical_url, source_domain, slug>."""
    return F.pandas_udf(_identity, IDENTITY)(raw)


def article_id(canonical_url: Column, raw: Column) -> Column:
    return F.sha2(F.coalesce(canonical_url, raw, F.lit("")), 256)


def story_group(slug: Column, bucket: Column, hazard: Column, article: Column) -> Column:
    """struct<id, method>: one group per hazard, six hours and slug; without a slug or time the article alone."""
    known = slug.isNotNull() & bucket.isNotNull()
    key = F.concat_ws("|", hazard, F.date_format(bucket, "yyyyMMddHH"), slug)
    return F.struct(F.when(known, F.sha2(key, 256)).otherwise(article).alias("id"), F.when(known, "url_slug_6h").otherwise("canonical_url").alias("method"))
