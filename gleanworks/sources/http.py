"""Landing payloads over HTTP: Python data sources whose partitions are pages, or boards that are walked.

``pages`` reads numbered pages of a ``{page}`` template, each a partition. ``walk`` reads one board per partition,
page by page, until a rule ends it. A page that fails yields a row without a payload, never an exception.
"""

from __future__ import annotations

import http.client
import json
import threading
import urllib.error
import urllib.parse
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Connections that a thread keeps open, redirects that a request follows, and seconds that it may take.
KEPT, REDIRECTS, TIMEOUT = 8, 5, 20.0


class Refused(Exception):
    """An answer of 400 or more."""

    def __init__(self, status: int) -> None:
        super().__init__(f"HTTP {status}")
        self.status = status


class Pool(threading.local):
    """Open connections of one thread by host; the least used goes first."""

    def __init__(self) -> None:
        self.open: OrderedDict[tuple[str, str], http.client.HTTPConnection] = OrderedDict()

    def take(self, scheme: str, host: str) -> tuple[http.client.HTTPConnection, bool]:
        """A connection, and whether it has been used before."""
        key = (scheme, host)
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key], True
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        self.open[key] = kind(host, timeout=TIMEOUT)
        while len(self.open) > KEPT:
            self.open.popitem(last=False)[1].close()
        return self.open[key], False

    def drop(self, scheme: str, host: str) -> None:
        if (c := self.open.pop((scheme, host), None)) is not None:
            c.close()


POOL = Pool()


def request(url: str, body: bytes | None = None, own: dict[str, str] | None = None) -> bytes:
    """The answer's bytes; a stale connection is tried once more on a new one. Raises Refused, or OSError.

    Headers of the caller's own go to the host that was asked alone, not where it redirects."""
    asked = urllib.parse.urlsplit(url).netloc
    for _ in range(REDIRECTS + 1):
        parts = urllib.parse.urlsplit(url)
        if parts.scheme == "file":
            with urllib.request.urlopen(url) as r:
                return r.read()
        if parts.scheme not in ("http", "https"):
            raise OSError(f"no transport for {parts.scheme}")
        path = urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, ""))
        headers = {"Connection": "keep-alive"} | ({"Content-Type": "application/json"} if body else {}) | ((own or {}) if parts.netloc == asked else {})
        for attempt in range(2):
            connection, used = POOL.take(parts.scheme, parts.netloc)
            try:
                connection.request("POST" if body else "GET", path, body, headers)
                answer = connection.getresponse()
                data = answer.read()
                break
            except (http.client.HTTPException, OSError) as e:
                POOL.drop(parts.scheme, parts.netloc)
                if attempt or not used:
                    raise OSError(type(e).__name__) from None
        if answer.status in (301, 302, 303, 307, 308) and (to := answer.getheader("Location")):
            url = urllib.parse.urljoin(url, to)
            continue
        if answer.status >= 400:
            raise Refused(answer.status)
        return data
    raise OSError("too many redirects")


def fetch(url: str, body: bytes | None = None) -> tuple[int | None, str | None]:
    """Status and text; a refused request is its status, an unreachable host no status."""
    try:
        return 200, request(url, body).decode("utf-8", "replace")
    except Refused as e:
        return e.status, None
    except urllib.error.URLError:
        return None, None
    except OSError:
        return None, None


def parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def host_of(url: str) -> str:
    return urllib.parse.urlsplit(url).netloc.lower()


def at_path(data: object, path: str) -> object:
    for part in path.split(".") if path else []:
        data = data.get(part) if isinstance(data, dict) else None
    return data


def walk(
    ask: Callable[..., tuple[int | None, str | None]], template: str, rule: str, most: int, size: int, items: str, total: str = "",
    body: str = ""
) -> Iterator[tuple[int, str | None, int | None]]:
    """(page, payload, status) of one board's walk; a failed page ends it, and so do most pages.

    rule ``short`` steps {offset} by size and ends with a page that has fewer items, or at the total that the first
    page told (later ones may say 0); with a body, which holds {offset}, it posts. Rule ``next`` follows the payload's
    next link as long as it stays on the host. Rule ``token`` hands on what the payload has at the path ``total``."""
    offset, url, told = 0, template.replace("{offset}", "0").replace("{page}", "1").replace("{token}", ""), None
    for n in range(most):
        status, text = ask(url, body.replace("{offset}", str(offset)).encode()) if body else ask(url)
        data = parsed(text)
        yield n, (json.dumps(data) if data is not None else None), status if data is not None or status != 200 else None
        if data is None:
            return
        if rule == "next":
            following = data.get("next") if isinstance(data, dict) else None
            if not following or host_of(following) != host_of(url):
                return
            url = following
            continue
        if rule == "token":
            token = at_path(data, total)
            if not token:
                return
            url = template.replace("{token}", urllib.parse.quote(str(token), safe=""))
            continue
        rows = at_path(data, items)
        if told is None and isinstance(at_path(data, total) if total else None, int):
            told = at_path(data, total)
        offset += size
        if not isinstance(rows, list) or len(rows) < size or (told is not None and offset >= told):
            return
        url = template.replace("{offset}", str(offset)).replace("{page}", str(n + 2)).replace("{token}", "")


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Page]:
        first, step = int(self.options.get("first", 1)), int(self.options.get("step", 1))
        return [Page(first + step * i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, part: Page) -> Iterator[tuple]:
        status, body = fetch(self.options["template"].format(page=part.number))
        data = parsed(body)
        yield part.number, json.dumps(data) if data is not None else None, status if data is not None or status != 200 else None, self.options.get("slug"), self.options.get("company")


class PagesSource(DataSource):
    """spark.read.format("pages").options(template=..., pages=10).load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "seq long, raw string, status int, slug string, company string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options)


class Board(InputPartition):
    def __init__(self, at: int, slug: str) -> None:
        self.at, self.slug = at, slug


class WalkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Board]:
        return [Board(i, s) for i, s in enumerate(self.options["slugs"].split(","))]

    def read(self, part: Board) -> Iterator[tuple]:
        o = self.options
        template = o["template"].replace("{slug}", part.slug)
        for n, raw, status in walk(
            fetch, template, o.get("rule", "short"), int(o.get("most", 10)), int(o.get("size", 100)), o.get("items", ""),
            o.get("total", ""), o.get("body", "")
        ):
            yield part.at * 10**6 + n, raw, status, part.slug


class WalkSource(DataSource):
    """spark.read.format("walk").options(template="https://host/{slug}?offset={offset}", slugs="a,b", size=100, items="content", total="totalFound").load()"""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return "seq long, raw string, status int, slug string"

    def reader(self, schema: StructType) -> WalkReader:
        return WalkReader(self.options)
