"""Imports from crawling services: plan, stage, package, index, record where it came from, seed the finding aid."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.operators import catalog
from webquarry.plans import ingest as plans
from webquarry.sources import finding_aids
from webquarry.sources.importers import ArchiveItClient, BrowsertrixClient, ServiceError, allowlisted, files_table, finding_aid, items_table, jobs_table, org_finding_aid
from webquarry.sources.locations import Source
from webquarry.sources.wacz_writer import build_wacz

STAGING = ".import-tmp"
#: What of a service's records may travel inside a package (names fixed by the service).
JOB_KEYS = ("id", "status", "type", "original_start_date", "end_date", "duplicate_count", "novel_count", "url_count", "elapsed_ms")
COLLECTION_KEYS = ("id", "name", "publicly_visible", "created_date", "last_crawl_date", "topics")

Download = Callable[[str, str], None]


def planned(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """crawl, files, bytes, importable: files by crawl, with what its job says; a crawl whose job isn't listed is kept."""
    stated = jobs.select(F.col("id").alias("crawl"), catalog.importable(jobs).alias("finished"))
    return catalog.plan_crawls(files).join(stated, "crawl", "left").select("crawl", "files", "bytes", F.coalesce("finished", F.lit(True)).alias("importable"))


def year_span(files: list[dict]) -> str | None:
    """First and last year of the files' times, one year alone if they are the same."""
    years = sorted({t[:4] for f in files if (t := f.get("crawl-time") or "")[:4].isdigit()})
    return "–".join(dict.fromkeys((years[0], years[-1]))) if years else None


def imported_items(crawls: list[dict]) -> set[str]:
    """Items that are in, by either trace: the source that they are streamed from, or the recorded provenance."""
    sources = (Source.parse(r["source"]) for r in crawls)
    return {s.parts[2] for s in sources if s.kind not in ("file", "url")} | {r["importer_item"] for r in crawls if r.get("importer_item")}


def import_crawls(spark: SparkSession, client: ArchiveItClient, home: str, into: str, download: Download, collection: int | None = None, force: bool = False, progress: plans.Progress = lambda kind, facts: None) -> dict:
    """Each crawl of the service that isn't in yet becomes one package of the collection `into`.

    download(url, path) stores a file. Staged files are removed after each crawl, also after a failure; what an earlier
    run left is removed first.
    """
    files, jobs = client.webdata(collection=collection), client.crawl_jobs(collection)
    titles = {c.get("id"): c for c in client.collections()}
    job_of = {j.get("id"): j for j in jobs}
    by_crawl: dict[int, list[dict]] = {}
    for f in files:
        by_crawl.setdefault(f.get("crawl") or 0, []).append(f)
    manifest = plans.Manifest.open(spark, home)
    done = {(r.get("importer_host"), r.get("importer_collection"), r.get("importer_item")) for r in manifest.rows.values()}
    outcome = {"imported": [], "skipped": [], "failed": []}
    shutil.rmtree(os.path.join(home, STAGING), ignore_errors=True)
    for row in planned(files_table(spark, files), jobs_table(spark, jobs)).orderBy("crawl").collect():
        crawl, own = row["crawl"], by_crawl.get(row["crawl"], [])
        source = next((f["collection"] for f in own if f.get("collection")), 0)
        if not row["importable"] or (not force and (client.host, source, str(crawl)) in done):
            outcome["skipped"].append(crawl)
            continue
        stage = os.path.join(home, STAGING, f"{source}-{crawl}")
        os.makedirs(stage)
        try:
            progress("phase", {"crawl": crawl, "phase": "downloading", "files": len(own)})
            staged = []
            for k, f in enumerate(own):
                if f.get("locations"):
                    os.makedirs(os.path.join(stage, str(k)))  # equal names don't meet
                    staged.append(os.path.join(stage, str(k), os.path.basename(f["filename"].replace("\\", "/")) or "file"))
                    download(f["locations"][0], staged[-1])
            if not staged:
                outcome["skipped"].append(crawl)
                continue
            title = (titles.get(source) or {}).get("name") or into
            name = f"{title} - crawl {crawl}"
            facts = {"crawl": allowlisted(job_of.get(crawl, {}), JOB_KEYS), "collection": allowlisted(titles.get(source, {}), COLLECTION_KEYS)}
            folder = os.path.join(home, "archive", into)
            os.makedirs(folder, exist_ok=True)
            package = os.path.join(folder, f"{source}-{crawl}.wacz")
            build_wacz(spark, staged, package, title=name, created=min((f["crawl-time"] for f in own if f.get("crawl-time")), default=None), extra={"service": {k: v for k, v in facts.items() if v}})
            found = plans.ingest(spark, home, [package], into, force=True, progress=progress, name=name)
            if found["failed"]:
                raise ServiceError(found["failed"][0][1])
            manifest = plans.Manifest.open(spark, home)
            manifest.set_provenance(found["indexed"][0], importer="archive-it", importer_host=client.host, importer_collection=source, importer_item=str(crawl), importer_files=len(staged), importer_name=title)
            outcome["imported"].append(found["indexed"][0])
        except (OSError, ValueError, ServiceError) as e:
            outcome["failed"].append((crawl, str(e)))
            progress("error", {"crawl": crawl, "message": str(e)})
        finally:
            shutil.rmtree(stage, ignore_errors=True)
    shutil.rmtree(os.path.join(home, STAGING), ignore_errors=True)
    finding_aids.seed(spark, home, into, finding_aid(titles.get(collection) or {}) | {"dates": year_span(files)})
    return outcome


def import_items(spark: SparkSession, client: BrowsertrixClient, home: str, into: str, org: dict, download: Download | None = None, opener=None, collection: dict | None = None, item: str | None = None, include_unreviewed: bool = False, least_review: int | None = None, force: bool = False, most: int | None = None, progress: plans.Progress = lambda kind, facts: None) -> dict:
    """Each package of a service's items that isn't in yet, by its hash, becomes a crawl of the collection `into`.

    With download(url, path), packages are stored under archive/; with an opener of locations, they are read where they
    are and only the index is written. Items that no one has reviewed stay out unless asked for or named by their id.
    """
    if (download is None) == (opener is None):
        raise ValueError("give either a download or an opener")
    found = client.items(org["id"], collection and collection["id"], item)
    passing = catalog.reviewed(F.col("review"), include_unreviewed or item is not None, least_review)
    wanted = {r["id"] for r in items_table(spark, found).where(passing).select("id").collect()}
    outcome = {"imported": [], "skipped": [], "failed": [], "unreviewed": [i["id"] for i in found if i["id"] not in wanted]}
    host = client.host.split("://")[-1]
    done = {(r.get("importer_host"), r.get("importer_item"), r.get("importer_hash")) for r in plans.Manifest.open(spark, home).rows.values()}
    for row in [i for i in found if i["id"] in wanted][:most]:
        for k, resource in enumerate(client.resources(org["id"], row)):
            mark = (host, row["id"], resource.get("hash") or "")
            if not force and mark in done:
                outcome["skipped"].append((row["id"], resource["name"]))
                continue
            try:
                progress("phase", {"item": row["id"], "phase": "reading" if opener else "downloading"})
                if opener:
                    location = Source("browsertrix", (host, org["id"], row["id"], resource["name"])).location
                else:
                    name = os.path.basename(resource["name"].replace("\\", "/")) or f"package-{k}.wacz"
                    location = os.path.join(home, "archive", into, row["id"], name)  # equal names of two items don't meet
                    os.makedirs(os.path.dirname(location), exist_ok=True)
                    download(resource["path"], location + ".part")
                    os.replace(location + ".part", location)
                got = plans.ingest(spark, home, [location], into, force=True, opener=opener, progress=progress, name=row.get("name") or None)
                if got["failed"]:
                    raise ServiceError(got["failed"][0][1])
                plans.Manifest.open(spark, home).set_provenance(got["indexed"][0], importer="browsertrix", importer_host=host, importer_item=row["id"], importer_hash=mark[2], review=row.get("reviewStatus"))
                done.add(mark)
                outcome["imported"].append(got["indexed"][0])
            except (OSError, ValueError, ServiceError) as e:
                outcome["failed"].append((row["id"], str(e)))
                progress("error", {"item": row["id"], "message": str(e)})
    finding_aids.seed(spark, home, into, org_finding_aid(org, collection))
    return outcome


class Resolver:
    """A readable location for an item of a token service: one client for each host, one new login when a token is refused."""

    def __init__(self, login: Callable[[str], BrowsertrixClient]):
        self.login, self.clients = login, {}

    def __call__(self, source: Source) -> str:
        host, org, item, resource = source.parts
        for fresh in (False, True):
            if fresh or host not in self.clients:
                self.clients[host] = self.login(host)
            try:
                found = self.clients[host].item_resources(org, item) if source.kind == "browsertrix" else self.clients[host].public_resources(org, item)
            except ServiceError:
                if fresh:
                    raise
                continue
            match = [r for r in found if r.get("name") == resource] or found[:1]
            if match:
                return match[0]["path"]
            raise ServiceError(f"{item} has no resource {resource}")
        raise AssertionError

