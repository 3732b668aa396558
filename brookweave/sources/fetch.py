"""Fetching pages: addresses are checked before every connection, bodies are bounded, a browser is the last rung.

A connection goes to an address that was resolved and found public; redirects are followed here, hop by hop, each hop
checked like the first address.  `ladder` escalates a page that looks like a bot wall, or whose request failed, to a
browser, unless the failure was a refusal or a timeout.  The browser itself is a function that the caller gives.
"""

from __future__ import annotations

import http.client
import socket
import ssl
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.urls import _public

#: Most bytes of a page, seconds of a connection, hops, the refusal's text.
BODY_BYTES, TIMEOUT_S, HOPS = 20_000_000, 15, 10
REFUSED = "blocked: non-public address"
AGENT = "Mozilla/5.0 (compatible; brookweave)"


@dataclass
class Fetched:
    url: str
    status: int | None
    html: str | None
    error: str | None = None


def hop_ok(url: str, public: Callable[[str], bool] = _public) -> bool:
    """http(s), and no literal address that is not public."""
    s = urlsplit(url)
    if s.scheme not in ("http", "https") or not s.hostname:
        return False
    try:
        socket.inet_pton(socket.AF_INET6 if ":" in s.hostname else socket.AF_INET, s.hostname)
    except OSError:
        return True
    return public(s.hostname)


def resolve(host: str, port: int, public: Callable[[str], bool] = _public) -> str:
    """A public address of the host; only what is checked here is connected to."""
    found = [x[4][0] for x in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    kept = [ip for ip in found if public(ip)]
    if not kept:
        raise PermissionError(REFUSED)
    return kept[0]


def error_class(e: BaseException) -> str:
    """refused, timeout or other."""
    if isinstance(e, PermissionError) or REFUSED in str(e):
        return "refused"
    return "timeout" if isinstance(e, TimeoutError) else "other"


def decode(raw: bytes, content_type: str | None) -> str:
    name = (content_type or "").lower().partition("charset=")[2].strip(" \"';") or "utf-8"
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def request(url: str, public: Callable[[str], bool] = _public, most: int = BODY_BYTES) -> Fetched:
    """One page by plain HTTP.  A longer body is cut if it is HTML, or of an unknown type, and an error otherwise."""
    for _ in range(HOPS + 1):
        if not hop_ok(url, public):
            raise PermissionError(REFUSED)
        s = urlsplit(url)
        port = s.port or (443 if s.scheme == "https" else 80)
        c = http.client.HTTPConnection(s.hostname, port, timeout=TIMEOUT_S)
        c.sock = socket.create_connection((resolve(s.hostname, port, public), port), TIMEOUT_S)
        if s.scheme == "https":
            c.sock = ssl.create_default_context().wrap_socket(c.sock, server_hostname=s.hostname)
        try:
            c.request("GET", (s.path or "/") + (f"?{s.query}" if s.query else ""), headers={"User-Agent": AGENT, "Accept": "text/html,*/*"})
            r = c.getresponse()
            if r.status in (301, 302, 303, 307, 308) and r.getheader("Location"):
                url = urljoin(url, r.getheader("Location"))
                continue
            kind = r.getheader("Content-Type")
            raw = r.read(most + 1)
            if len(raw) > most and kind and not any(k in kind.lower() for k in ("text/html", "application/xhtml")):
                raise ValueError("body exceeds 20MB")
            return Fetched(url, r.status, decode(raw[:most], kind))
        finally:
            c.close()
    raise ValueError("too many redirects")


def ladder(url: str, cheap: Callable[[str], Fetched], walled: Callable[[Fetched], bool], browser: Callable[[str], Fetched] | None = None) -> tuple[Fetched, str, bool]:
    """(page, tier, escalated): plain HTTP, and a browser where the page is walled or the request failed otherwise than by
    a refusal or a timeout.  The place where a browser ends is checked again; without one the cheap page stays."""
    got, failed = None, None
    try:
        got = cheap(url)
        if not walled(got):
            return got, "http", False
    except Exception as e:
        if error_class(e) != "other":
            raise
        failed = e
    if browser is not None:
        try:
            page = browser(url)
        except Exception as e:
            failed = failed or e
        else:
            if not hop_ok(page.url):
                raise PermissionError(REFUSED)
            return page, "chrome", True
    if got is None:
        raise failed
    return got, "http", False


def fetch_pages(urls: DataFrame, parallel: int = 4, fetch: Callable[[str], Fetched] = request) -> DataFrame:
    """(ord, url, status, html, error, reason): every url of (ord, url) fetched once, errors kept as rows.

    The order of the input is the column ord; a sink that needs it sorts, so no global sort runs here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for o, u in zip(b["ord"], b["url"]):
                try:
                    f = fetch(u)
                    rows.append((o, u, f.status, f.html, f.error))
                except Exception as e:  # one bad page must not fail the others
                    rows.append((o, u, None, None, f"{error_class(e)}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["ord", "url", "status", "html", "error"], dtype=object)

    got = urls.select("ord", "url").repartition(parallel).mapInPandas(run, "ord bigint, url string, status int, html string, error string")
    return got.withColumn("reason", P.block_reason(F.col("status"), F.col("html")))
