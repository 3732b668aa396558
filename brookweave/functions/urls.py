"""URL and host expressions."""

from __future__ import annotations

import ipaddress
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Networks that no request may go to (first and last address).
PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "239.255.255.255"),
    ("255.255.255.255", "255.255.255.255"),
)
#: Hosts of search engines, whose own pages are no results.
ENGINE_HOSTS = ("bing.com", "duckduckgo.com", "mojeek.com", "brave.com", "search.yahoo.com")


def host_of(url: Column) -> Column:
    """The lower-cased host, '' for what is no URL."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, one trailing slash less; what is no http(s) URL stays."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    low = F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))
    path = F.when(low.rlike(r"^[a-z]+://[^/?]+$"), F.concat(low, F.lit("/"))).otherwise(low)
    cut = F.when(path.endswith("/") & (F.length(path) > 8), F.substr(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    return F.when(head != "", cut).otherwise(url)


def is_pdf(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf")


def v4_number(ip: Column) -> Column:
    """The address as a number, null for what is no dotted quad."""
    part = F.split(ip, r"\.")
    n = lambda i: F.try_element_at(part, F.lit(i)).try_cast("bigint") if hasattr(ip, "try_cast") else F.try_element_at(part, F.lit(i)).cast("bigint")
    number = ((n(1) * 256 + n(2)) * 256 + n(3)) * 256 + n(4)
    return F.when(ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), number)


def _number(ip: str) -> int:
    return int(ipaddress.IPv4Address(ip))


def public_v4(ip: Column) -> Column:
    """Whether an address is a public IPv4 one: range predicates over its number."""
    n = v4_number(ip)
    inside = F.lit(False)
    for a, b in PRIVATE_V4:
        inside = inside | n.between(_number(a), _number(b))
    return F.when(n.isNull(), F.lit(False)).otherwise(~inside)


def _public(ip: str) -> bool:
    try:
        a = ipaddress.ip_address(ip.strip("[]"))
    except ValueError:
        return False
    if a.version == 6:
        n = int(a)
        if n >> 32 in (0xFFFF, 0) and n > 1:
            a = ipaddress.IPv4Address(n & 0xFFFFFFFF)
        elif n >> 112 == 0x2002:
            a = ipaddress.IPv4Address(n >> 80 & 0xFFFFFFFF)
        elif n >> 32 == 0x0064FF9B << 64 or n >> 80 == 0x0064FF9B0001:
            a = ipaddress.IPv4Address(n & 0xFFFFFFFF)
        else:
            return not (n <= 1 or a.is_multicast or n >> 121 == 0x7E or n >> 118 == 0x3FA)
    n = int(a)
    return not any(_number(x) <= n <= _number(y) for x, y in PRIVATE_V4)


@F.pandas_udf(BooleanType())
def public_ip(ip: pd.Series) -> pd.Series:
    """Whether an address (either version, embedded ones included) is public; null stays null."""
    return ip.map(lambda x: None if x is None else _public(x))


def valid(url: Column) -> Column:
    """http(s) only, no literal IPv4 address that is not public and no literal IPv6 address at all."""
    host = host_of(url)
    literal = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    return url.rlike(r"(?i)^https?://[^/?#\s]+") & (host != "") & (~literal | public_v4(host)) & (host != "localhost") & ~F.contains(host, F.lit(":"))


def host_matches(host: Column, domain: Column) -> Column:
    """host is the domain or one of its subdomains; dots and www. at the front do not count."""
    d = F.regexp_replace(F.lower(F.regexp_replace(domain, r"^\.+|\.+$", "")), r"^www\.", "")
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    return (h == d) | F.endswith(h, F.concat(F.lit("."), d))


def junk(url: Column) -> Column:
    """Advertisement redirects and the engines' own pages."""
    host = host_of(url)
    own = F.lit(False)
    for e in ENGINE_HOSTS:
        own = own | host.endswith(e)
    return F.contains(url, F.lit("duckduckgo.com/y.js")) | own | (host == "")


def encode_query(text: Column) -> Column:
    """Unreserved characters stay, a blank is +, all else is %XX."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def encode_path(text: Column) -> Column:
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%40", "@"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(StringType())
def decode_percent(text: pd.Series) -> pd.Series:
    """Percent decoding that keeps what is no hex as it is and reads the bytes as UTF-8, lossily."""
    return text.map(lambda x: None if x is None else unquote_to_bytes(x).decode("utf-8", "replace"))


def unwrap_param(url: Column, name: str) -> Column:
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def unwrap_base64(url: Column) -> Column:
    """The target in a redirect's u parameter: a1, then base64url without padding; null if it is no http URL."""
    raw = F.regexp_replace(F.try_parse_url(url, F.lit("QUERY"), F.lit("u")), "^a1", "")
    plain = F.translate(raw, "-_", "+/")
    full = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    text = F.try_to_binary(full, F.lit("base64")).cast("string")
    return F.when(text.startswith("http"), text)


def unwrap_path(url: Column) -> Column:
    """The target after RU= up to the next slash."""
    text = F.try_url_decode(F.regexp_extract(url, "RU=([^/]*)", 1))
    return F.when(text.startswith("http"), text)


def repo_spec(text: Column) -> Column:
    """struct(owner, repo) of a repository name or URL; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:https?://)?(?:www\.)?github\.com/", ""), r"^git@github\.com:", "")
    owner = F.regexp_extract(bare, r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?(?:[/?#].*)?$", 1)
    repo = F.regexp_extract(bare, r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?(?:[/?#].*)?$", 2)
    return F.when((owner != "") & (repo != ""), F.struct(owner.alias("owner"), repo.alias("repo")))


def join(href: str | None, base: str | None) -> str | None:
    """href resolved against its page; null for fragments, data: and javascript: ones and over 2048 bytes."""
    if not href or href.strip()[:1] in ("", "#") or href.strip().lower().startswith(("javascript:", "data:")):
        return None
    try:
        s = urlsplit(urljoin(base or "", href.strip()))
        out = urlunsplit(s._replace(path=quote(s.path, safe="/%:@!$&'()*+,;=~-._"), query=quote(s.query, safe="=&%/?:@!$'()*+,;~-._[]")))
    except ValueError:
        return None
    return out if len(out.encode()) <= 2048 else None


@F.pandas_udf(StringType())
def absolute(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([join(h, b) for h, b in zip(href, base)])
