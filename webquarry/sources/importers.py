"""Clients of two crawling services, on an injected transport, and their listings as DataFrames.

A transport is a callable (method, url, headers, body) -> (status, bytes).
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession

Transport = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]
PAGE, MOST_PAGES = 100, 10_000


class ServiceError(RuntimeError):
    pass


def snippet(body: bytes, most: int = 300) -> str:
    text = body.decode("utf-8", "replace").strip()
    return text if len(text) <= most else text[:most] + "…"


def urllib_transport(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method=method), timeout=60) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class _Client:
    def __init__(self, host: str, transport: Transport, auth: str | None):
        self.host, self.transport, self.auth = host.rstrip("/"), transport, auth

    def get(self, path: str, auth: bool = True):
        url = path if path.startswith("http") else self.host + path
        status, body = self.transport("GET", url, {"Authorization": self.auth} if auth and self.auth else {}, None)
        if not 200 <= status < 300:
            raise ServiceError(f"GET {url} failed (HTTP {status}): {snippet(body)}")
        try:
            return json.loads(body)
        except ValueError as e:
            raise ServiceError(f"{url} did not answer with JSON") from e


class BrowsertrixClient(_Client):
    """Token login, pages of items, orgs, collections and replay resources."""

    page_size = PAGE

    @classmethod
    def login(cls, host: str, user: str, password: str, transport: Transport = urllib_transport) -> BrowsertrixClient:
        form = urlencode({"username": user, "password": password}).encode()
        status, body = transport("POST", host.rstrip("/") + "/api/auth/jwt/login", {"Content-Type": "application/x-www-form-urlencoded"}, form)
        if not 200 <= status < 300:
            raise ServiceError(f"login failed (HTTP {status}): {snippet(body)}")
        return cls(host, transport, "Bearer " + json.loads(body)["access_token"])

    def listed(self, path: str, **params: str) -> list[dict]:
        out: list[dict] = []
        for page in range(1, MOST_PAGES + 1):
            more = "".join(f"&{k}={quote(v, safe='')}" for k, v in params.items())
            found = self.get(f"{path}?page={page}&pageSize={self.page_size}{more}")
            items = found.get("items") or []
            out += items
            total = found.get("total") or 0
            if len(items) < self.page_size or (total and len(out) >= total):
                return out
        raise ServiceError(f"{path} still had pages after {MOST_PAGES}")

    def orgs(self) -> list[dict]:
        return self.listed("/api/orgs")

    def collections(self, org: str) -> list[dict]:
        return self.listed(f"/api/orgs/{org}/collections")

    def items(self, org: str, collection: str | None = None, item: str | None = None) -> list[dict]:
        return self.listed(f"/api/orgs/{org}/all-crawls", **({"collectionId": collection} if collection else {}), **({"ids": item} if item else {}))

    def resources(self, org: str, item: dict) -> list[dict]:
        kind = "uploads" if item.get("type") == "upload" else "crawls"
        return self.get(f"/api/orgs/{org}/{kind}/{item['id']}/replay.json").get("resources") or []

    def item_resources(self, org: str, item_id: str) -> list[dict]:
        """Tries both kinds, for an item whose kind isn't known."""
        failed: ServiceError | None = None
        for kind in ("crawls", "uploads"):
            try:
                if found := self.get(f"/api/orgs/{org}/{kind}/{item_id}/replay.json").get("resources"):
                    return found
            except ServiceError as e:
                failed = e
        raise failed or ServiceError(f"no resources for item {item_id}")

    def public_collections(self, slug: str) -> tuple[dict, list[dict]]:
        found = self.get(f"/api/public/orgs/{slug}/collections", auth=False)
        return found.get("org") or {}, found.get("collections") or []

    def public_resources(self, org: str, collection: str) -> list[dict]:
        return self.get(f"/api/orgs/{org}/collections/{collection}/public/replay.json", auth=False).get("resources") or []


class ArchiveItClient(_Client):
    """Basic auth, arrays of collections and jobs, and cursor pages of files."""

    @classmethod
    def basic(cls, host: str, user: str, password: str, transport: Transport = urllib_transport) -> ArchiveItClient:
        return cls(host, transport, "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())

    def collections(self, active_only: bool = False) -> list[dict]:
        return self.get("/api/collection?format=json&limit=-1" + ("&state=ACTIVE" if active_only else ""))

    def crawl_jobs(self, collection: int | None = None) -> list[dict]:
        return self.get("/api/crawl_job?format=json&limit=-1" + (f"&collection={collection}" if collection is not None else ""))

    def webdata(self, **filters) -> list[dict]:
        names = ("collection", "crawl", "crawl_time_after", "crawl_time_before")
        query = urlencode([(n.replace("_", "-"), filters[n]) for n in names if filters.get(n) is not None])
        url, out = f"{self.host}/wasapi/v1/webdata" + (f"?{query}" if query else ""), []
        for _ in range(MOST_PAGES):
            page = self.get(url)
            out += page.get("files") or []
            url = page.get("next")
            if not url:
                return out
        raise ServiceError(f"file list still had pages after {MOST_PAGES}")


def credentials(prefix: str) -> tuple[str, str, str] | None:
    """host, user and password from the environment only."""
    found = tuple(os.environ.get(f"{prefix}_{k}", "") for k in ("HOST", "USER", "PASSWORD"))
    return found if all(found) else None


def choose(rows: list[dict], wanted: str | None, keys: tuple[str, ...] = ("id", "slug", "name")) -> dict:
    """The sole row, or the one that a key names."""
    if wanted is None:
        if len(rows) == 1:
            return rows[0]
        raise ServiceError(f"choose one of: {', '.join(str(r.get(keys[1]) or r.get('id')) for r in rows)}")
    for k in keys:
        for r in rows:
            if str(r.get(k, "")).lower() == wanted.lower():
                return r
    raise ServiceError(f"no such entry: {wanted}")


def items_table(spark: SparkSession, items: list[dict]) -> DataFrame:
    rows = [(i["id"], i.get("name") or "", i.get("type") or "", i.get("fileSize") or 0, i.get("reviewStatus"), (i.get("finished") or i.get("created") or "")[:10] or None) for i in items]
    return spark.createDataFrame(rows, "id string, name string, type string, bytes bigint, review int, date string")


def files_table(spark: SparkSession, files: list[dict]) -> DataFrame:
    rows = [(f["filename"], f.get("size") or 0, f.get("collection"), f.get("crawl"), f.get("crawl-time"), (f.get("checksums") or {}).get("sha1"), f.get("locations") or []) for f in files]
    return spark.createDataFrame(rows, "filename string, size bigint, collection bigint, crawl bigint, crawl_time string, sha1 string, locations array<string>")


def jobs_table(spark: SparkSession, jobs: list[dict]) -> DataFrame:
    named = ("id", "status", "test_crawl_state", "type", "collection", "original_start_date", "end_date")
    rows = [(*(j.get(n) for n in named), {k: json.dumps(v) for k, v in j.items() if k not in named}) for j in jobs]
    return spark.createDataFrame(rows, "id bigint, status string, test_crawl_state string, type string, collection bigint, original_start_date string, end_date string, extra map<string,string>")


# ---------------------------------------------------------------- descriptive metadata


def metadata_values(collection: dict, key: str) -> list[str]:
    md = collection.get("metadata")
    field = next((v for k, v in md.items() if k.lower() == key.lower()), None) if isinstance(md, dict) else None
    out = []
    for x in field if isinstance(field, list) else [field]:
        v = x.get("value") if isinstance(x, dict) else x
        if isinstance(v, str) and v:
            out.append(v)
    return out


#: Words that stay small inside a topic's title.
SMALL = frozenset(("and", "of", "the", "for"))


def topic_title(code: str) -> str:
    """A camel-case topic code as a title: a capital begins a word."""
    first, *rest = re.findall(r"[^A-Z]+|[A-Z][^A-Z]*", code.strip()) or [""]
    return " ".join([first.capitalize(), *(w.lower() if w.lower() in SMALL else w.capitalize() for w in rest)])


def finding_aid(collection: dict) -> dict:
    """Dublin Core metadata and topics as the fields of a finding aid; what isn't known stays out."""
    first = lambda k: next(iter(metadata_values(collection, k)), None)
    topics = collection.get("topics")
    topics = topics if isinstance(topics, list) else [topics] if isinstance(topics, str) and topics else []
    subjects = metadata_values(collection, "Subject") + [topic_title(t) for t in topics if isinstance(t, str)]
    found = {"narrative": first("Description"), "description": first("Title"), "creator": first("Creator") or first("Collector"), "rights": first("Rights"), "subjects": subjects or None}
    return {k: v for k, v in found.items() if v}


def org_finding_aid(org: dict, collection: dict | None = None) -> dict:
    """The other service's fields: the organisation collects; a chosen collection gives text, subjects and dates, never rights."""
    text = lambda row, k: row[k].strip() if isinstance(row.get(k), str) else ""
    name, site, c = text(org, "name"), text(org, "website"), collection or {}
    days = [d[:10] for k in ("dateEarliest", "dateLatest") if (d := text(c, k))]
    found = {"creator": f"{name} ({site})" if name and site else name, "narrative": text(c, "description"), "description": text(c, "caption"), "subjects": c.get("tags") or None, "dates": " – ".join(dict.fromkeys(days))}
    return {k: v for k, v in found.items() if v}


def allowlisted(row: dict, keys: tuple[str, ...]) -> dict:
    """Named keys whose values are set: all else stays out of what is published."""
    return {k: row[k] for k in keys if row.get(k) is not None}
