"""Captures of watched addresses: conditional requests, retries, routes and rendering.

``fetch`` takes a table of addresses, so that they never pass the driver. For
small lists there is a batch data source besides: ``spark.dataSource.register(CaptureSource)``,
then ``spark.read.format("captures")`` with the option ``watched``, JSON lines
of {url, etag, last_modified, proxy, force_proxy, render}. The client, and a
renderer where a browser is at hand, are pluggable ("module:function"); the
default client uses the standard library.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from changewatch.config import Config, from_mapping
from changewatch.operators.gates import holds_signature

Client = Callable[[dict], dict]

SCHEMA = "url string, attempt int, route_no int, status string, text string, etag string, last_modified string, http_status int, error string, duration_ms bigint, rendered boolean"
WATCHED = ("url", "etag", "last_modified", "proxy", "force_proxy", "render")


def http_client(request: dict) -> dict:
    """Ask once: {status, body, headers}. 304 and other statuses are answers; failures of the network raise."""
    import urllib.error
    import urllib.request

    req = urllib.request.Request(request["url"], headers=request["headers"])
    handlers = [urllib.request.ProxyHandler({"http": request["proxy"], "https": request["proxy"]})] if request.get("proxy") else []
    try:
        with urllib.request.build_opener(*handlers).open(req, timeout=request["timeout"]) as r:
            return {"status": r.status, "body": r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), "headers": {k.lower(): v for k, v in r.headers.items()}}
    except urllib.error.HTTPError as e:
        return {"status": e.code, "body": "", "headers": {k.lower(): v for k, v in e.headers.items()}}


def request_headers(watched: dict, agent: str) -> dict[str, str]:
    """With the validators of the last capture, so that an unchanged page need not be sent."""
    out = {"User-Agent": agent}
    if watched.get("etag"):
        out["If-None-Match"] = watched["etag"]
    if watched.get("last_modified"):
        out["If-Modified-Since"] = watched["last_modified"]
    return out


# fixed values: the settings that make up a proxy's address
PROXY_SETTINGS = ("PROXY_HOST", "PROXY_PORT", "PROXY_USER", "PROXY_PASS")


def proxy_address(settings: Mapping[str, str | None]) -> str | None:
    """A proxy's address from its four settings, for the column ``proxy``; None unless all four are there, so that half a setting is no proxy. User and password are percent-encoded."""
    from urllib.parse import quote

    host, port, user, password = (settings.get(k) for k in PROXY_SETTINGS)
    return f"http://{quote(user, safe='')}:{quote(password, safe='')}@{host}:{port}" if host and port and user and password else None


def is_safe(url: str) -> bool:
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.netloc)


def worth_rendering(code: int | None) -> bool:
    """As ``operators.gates.worth_rendering``: a client error that says the page is not there is an answer."""
    return code is None or not 400 <= code <= 499 or code in (401, 403, 405, 406, 429)


def attempts(watched: dict, client: Client, render: Client | None = None, cfg: Config = Config()) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` until an answer is usable: direct, then by the proxy, each asked plainly and then rendered, and all again after a pause.

    An unsafe address is refused unasked. A 304, or a page with text that is no
    block page, ends it. Without a renderer nothing is rendered; what is asked
    for rendered is then taken as it comes.
    """
    url, f = watched["url"], cfg.fetch
    if not url or not is_safe(url):
        yield url, 0, 0, "failed", None, None, None, None, "unsafe address, refused", 0, False
        return
    routes = [(1, watched["proxy"])] if watched.get("proxy") and watched.get("force_proxy") else [(0, None), *([(1, watched["proxy"])] if watched.get("proxy") else [])]
    validators = {} if f.disable_conditional_get else watched
    for attempt in range(1, f.max_retries + 1):
        if attempt > 1 and f.retry_delay_seconds:
            time.sleep(f.retry_delay_seconds)
        for route, proxy in routes:
            code, heads = None, {}
            for rendered, ask in ((False, client), (True, render)):
                if ask is None or rendered and not worth_rendering(code):
                    continue
                began = time.monotonic()
                row = lambda status, text, error: (url, attempt, route, status, text, heads.get("etag"), heads.get("last-modified"), code, error, int((time.monotonic() - began) * 1000), rendered)  # noqa: E731, B023
                request = {"url": url, "headers": request_headers({} if rendered else validators, f.user_agent), "proxy": proxy, "timeout": f.page_load_timeout if rendered else f.timeout_seconds}
                try:
                    got = ask(request)
                except Exception as e:  # noqa: BLE001  any failure of a client is a failed attempt
                    yield row("failed", None, f"{type(e).__name__}: {e}")
                    continue
                # a browser gives no validators: those of the plain answer go with what it shows
                code, heads = got["status"], got["headers"] or heads
                if code == 304:
                    heads = {"etag": heads.get("etag") or watched.get("etag"), "last-modified": heads.get("last-modified") or watched.get("last_modified")}
                    yield row("not_modified", None, None)
                    return
                if code >= 400:
                    yield row("failed", None, f"HTTP {code}")
                    continue
                yield row("ok", got["body"], None)
                asks_more = watched.get("render") and not rendered and render is not None
                if got["body"].strip() and not holds_signature(got["body"], cfg.validation.failure_signatures) and not asks_more:
                    return


def _named(function: str | None) -> Client | None:
    if not function:
        return None
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def fetch(watched: DataFrame, cfg: Config = Config(), *, client: str | None = None, render: str | None = None) -> DataFrame:
    """All attempts (``SCHEMA``) for a table of addresses: url, and if there are such columns etag, last_modified, proxy, force_proxy, render.

    Tasks ask one address after the other; give the table as many partitions
    as addresses may be asked at once. A null address is refused.
    """
    rows = watched.select(*(c for c in WATCHED if c in watched.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, browser = _named(client) or http_client, _named(render)
        for batch in batches:
            for w in batch.to_pylist():
                found = list(attempts(w, ask, browser, cfg))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]
    return rows.mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, watched: list[dict]):
        self.watched = watched


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.watched = [json.loads(x) for x in options.get("watched", "").splitlines() if x.strip()]
        self.parts, self.client, self.render = int(options.get("partitions", 8)), options.get("client"), options.get("render")
        self.cfg = from_mapping(json.loads(options["config"])) if options.get("config") else Config()

    def partitions(self):
        n = max(1, min(self.parts, len(self.watched)))
        return [_Part(self.watched[i::n]) for i in range(n)]

    def read(self, partition):
        for w in partition.watched:
            yield from attempts(w, _named(self.client) or http_client, _named(self.render), self.cfg)


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
