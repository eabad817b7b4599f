"""Packages to a published index: resume, read, merge, derive, upsert, one commit for each package."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import json
import os
import shutil
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.config import Config, load
from webquarry.functions import langdetect, suffixes, trigrams
from webquarry.functions.scalars import host
from webquarry.operators import documents, maintain
from webquarry.sources import finding_aids, http_range, wacz
from webquarry.sources.pdf import extract_text
from webquarry.sources.files import Store
from webquarry.sources.locations import Source

Progress = Callable[[str, dict], None]
PdfText = Callable[[bytes], str | None]
#: Fields of a crawl that an import sets and reading the package again must not lose.
PROVENANCE = ("importer", "importer_host", "importer_item", "importer_collection", "importer_hash", "importer_files", "importer_name", "review", "crawl_date")


def crawl_id(location: str) -> str:
    return hashlib.sha256(location.encode()).hexdigest()[:8]


def display_name(source: Source) -> str:
    last = source.parts[-1].split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1] or source.parts[-1]
    return next((last.removesuffix(s) for s in (".warc.gz", ".warc", ".wacz") if last.endswith(s)), last)


@dataclass
class Manifest:
    """Crawls that are in, by id: the resume list. Provenance of an import is kept when a crawl is read again."""

    spark: SparkSession
    home: str
    rows: dict[str, dict] = field(default_factory=dict)

    NAME = "crawls.json"

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> Manifest:
        text = Store(spark, home).read(cls.NAME)
        return cls(spark, home, {r["id"]: r for r in json.loads(text)} if text else {})

    def save(self) -> None:
        Store(self.spark, self.home).put(self.NAME, json.dumps(sorted(self.rows.values(), key=lambda r: r["id"]), indent=1))

    def members(self, collection: str) -> list[dict]:
        return [r for r in sorted(self.rows.values(), key=lambda r: r["id"]) if r["collection"] == collection]

    def put(self, row: dict) -> None:
        """A crawl's facts from its package; what setters recorded before stays."""
        old = self.rows.get(row["id"], {})
        self.rows[row["id"]] = {k: v for k, v in old.items() if k in PROVENANCE} | row
        self.save()

    def set_provenance(self, crawl: str, **facts) -> None:
        """importer (service, host), importer_item, importer_hash, importer_collection, review, crawl_date: set, and kept from then on."""
        if unknown := set(facts) - set(PROVENANCE):
            raise KeyError(f"not a provenance field: {sorted(unknown)}")
        if crawl not in self.rows:
            raise KeyError(f"no crawl with the id {crawl}")
        self.rows[crawl] |= facts
        self.save()

    def remove(self, *crawls: str) -> None:
        for c in crawls:
            self.rows.pop(c, None)
        self.save()

    def is_present(self, crawl: str) -> bool:
        """Whether the crawl's package can be read: a remote one counts as there."""
        source = Source.parse(self.rows[crawl]["source"])
        return source.remote or os.path.exists(source.resolve(self.home))


def place(path: str, home: str, move: bool = False) -> str:
    """File a local package under archive/: an identical file is reused, another of its name gets a number. move: take it rather than copy."""
    folder = os.path.join(home, "archive")
    os.makedirs(folder, exist_ok=True)
    if os.path.realpath(path).startswith(os.path.realpath(folder) + os.sep):
        return path
    stem, dot, ext = os.path.basename(path).partition(".")
    for n in itertools.count(1):
        dest = os.path.join(folder, f"{stem}{'' if n == 1 else f'-{n}'}{dot}{ext}")
        if not os.path.exists(dest):
            break
        if os.path.getsize(dest) == os.path.getsize(path) and maintain.file_sha256(dest) == maintain.file_sha256(path):
            return dest
    if move:
        shutil.move(path, dest)
    else:
        shutil.copyfile(path, dest + ".part")
        os.replace(dest + ".part", dest)
    return dest


def pages_of(spark: SparkSession, crawl: str, path: str, opener=wacz.open_local, pdf_text: PdfText | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """Merged pages of one package; skipped counts the records that can't be read."""
    return documents.merge_pages(wacz.read_package(spark, crawl, path, opener, pdf_text, skipped))


def as_documents(pages: DataFrame, name: Column | str, collection: Column | str, cfg: Config, profiles: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Documents of merged pages; name and collection: a value for all, or columns of pages.

    profiles: what the home knows of languages (trigrams); its answer counts before that of scripts and frequent words.
    """
    value = lambda v: F.lit(v) if isinstance(v, str) else v
    keyed = pages.withColumn("doc_id", doc_id()).withColumn("crawl_name", value(name)).withColumn("collection", value(collection))
    site = suffixes.site(pages.sparkSession, host("url"))
    guess = langdetect.detected("body")
    lang = F.coalesce(trigrams.told("body", profiles), guess) if profiles else guess
    return documents.derive(keyed, site=site, lang=lang, snip_bytes=cfg.snip_bytes)


def doc_id() -> Column:
    """From crawl and url: the same for every reading of a package."""
    return F.xxhash64("crawl_id", "url").bitwiseAND(F.lit((1 << 62) - 1))


def crawl_document(spark: SparkSession, row: dict) -> DataFrame:
    """The document that makes a crawl itself findable."""
    facts = (int(row["id"], 16), row["id"], row["name"], row["collection"], row.get("description"), row.get("created"), [(p["url"], p["title"], p["ts"]) for p in row.get("seed_pages") or []])
    return documents.collection_documents(spark.createDataFrame([facts], "doc_id bigint, id string, name string, collection string, description string, created string, seed_pages array<struct<url:string,title:string,ts:string>>"))


def fetched(location: str, home: str, source: Callable[[str], BinaryIO] | None = None) -> str:
    """A remote package as a file under the home, for servers that don't serve byte ranges; an unfinished download never bears its name."""
    folder = os.path.join(home, "downloads")
    os.makedirs(folder, exist_ok=True)
    dest = os.path.join(folder, f"{crawl_id(location)}.wacz")
    if not os.path.exists(dest):
        with (source or urllib.request.urlopen)(location) as f:
            http_range.download(iter(lambda: f.read(1 << 20), b""), dest)
    return dest


def ingest(spark: SparkSession, home: str, locations: list[str], collection: str, force: bool = False, opener=None, progress: Progress = lambda kind, facts: None, pdf_text: PdfText | None = extract_text, move: bool = False, name: str | None = None) -> dict:
    """Index packages one by one; each is durable once its version is published. Registered ones are skipped.

    A remote package is read by byte ranges; where its server doesn't serve them it is downloaded, read and removed. A
    package that is in another collection is refused unless forced. pdf_text gives the text of a PDF's bytes; None leaves PDFs without text.
    """
    cfg, manifest, outcome = load(home), Manifest.open(spark, home), {"indexed": [], "skipped": [], "failed": []}
    progress("begin", {"packages": len(locations)})
    for text in locations:
        source = Source.parse(text)
        path = text if source.remote else place(text, home, move)
        stored = text if source.remote else Source.for_file(path, home).location
        cid = crawl_id(stored)
        if not force and cid in manifest.rows:
            if manifest.rows[cid]["collection"] == collection:
                outcome["skipped"].append(cid)
                progress("skipped", {"crawl": cid})
            else:
                outcome["failed"].append((cid, f"is in collection {manifest.rows[cid]['collection']} already"))
                progress("error", {"crawl": cid, "message": outcome["failed"][-1][1]})
            continue
        use, loaded = opener or (http_range.open_any if source.remote else wacz.open_local), None
        try:
            progress("phase", {"crawl": cid, "phase": "reading"})
            if source.kind == "url" and opener is None:
                try:
                    http_range.open_any(path).close()
                except http_range.NoRanges:
                    progress("phase", {"crawl": cid, "phase": "downloading"})
                    path = loaded = fetched(path, home)
            with use(path) as f:
                meta = wacz.read_datapackage(f)
            row = {"id": cid, "name": name or meta["title"] or display_name(source), "collection": collection, "source": stored, "sha256": None if source.remote else maintain.file_sha256(path)} | {k: meta[k] for k in ("title", "description", "created", "software", "keywords", "licenses", "creator", "seed_pages")}
            skipped = spark.sparkContext.accumulator(0)
            docs = as_documents(pages_of(spark, cid, path, use, pdf_text, skipped), row["name"], collection, cfg, trigrams.load(spark, home))
            maintain.upsert(spark, home, docs.unionByName(crawl_document(spark, row)), [cid])
        except (OSError, ValueError, KeyError) as e:
            outcome["failed"].append((cid, str(e)))
            progress("error", {"crawl": cid, "message": str(e)})
            continue
        finally:
            if loaded:
                os.remove(loaded)
        found = maintain.documents(spark, home).where((F.col("crawl_id") == cid) & (F.col("doc_type") == "page"))
        facts = found.agg(F.count("*").alias("n"), F.min(F.nullif("timestamp", F.lit(""))).alias("a"), F.max(F.nullif("timestamp", F.lit(""))).alias("b")).first()
        manifest.put(row | {"page_count": facts["n"], "capture_start": facts["a"], "capture_end": facts["b"]})
        outcome["indexed"].append(cid)
        progress("indexed", {"crawl": cid, "pages": facts["n"], "unreadable": skipped.value})
    if outcome["indexed"]:
        finding_aids.seed(spark, home, collection, {})
        if maintain.fragmented(spark, home):
            progress("phase", {"phase": "compacting"})
            maintain.compact(spark, home, progress=progress)
    progress("done", {k: len(v) for k, v in outcome.items()})
    return outcome


def rebuild(spark: SparkSession, home: str, opener=None, pdf_text: PdfText | None = extract_text) -> dict:
    """Read every registered package again into one new version; packages that fail are reported and left out.

    Names, collections and provenance come from the manifest and stay as they are. Crawls that no package holds
    (streamed ones, and those that were put into the index alone) are carried over as they are, and reported.
    """
    cfg, manifest, parts, failed = load(home), Manifest.open(spark, home), [], []
    packages = {cid: row for cid, row in manifest.rows.items() if Source.parse(row["source"]).kind != "stream"}
    for cid, row in packages.items():
        source = Source.parse(row["source"])
        path = source.location if source.remote else source.resolve(home)
        try:
            with (opener or wacz.open_local)(path) as f:
                wacz.read_datapackage(f)
            parts.append(as_documents(pages_of(spark, cid, path, opener or wacz.open_local, pdf_text), row["name"], row["collection"], cfg, trigrams.load(spark, home)).unionByName(crawl_document(spark, row)))
        except (OSError, ValueError) as e:
            failed.append((cid, str(e)))
    carried = sorted({c for own in maintain.segments(spark, home).values() for c in own} - set(packages))
    if parts:
        maintain.replace_all(spark, home, functools.reduce(DataFrame.unionByName, parts), carried)
    return {"indexed": len(parts), "failed": failed, "carried": carried}


# ---------------------------------------------------------------- deletion


def plan_crawl_deletion(spark: SparkSession, home: str, crawl: str) -> dict:
    """What deleting a crawl takes: its file only if it lies under archive/ and no other crawl uses it."""
    manifest = Manifest.open(spark, home)
    if crawl not in manifest.rows:
        raise KeyError(f"no crawl with the id {crawl}")
    row = manifest.rows[crawl]
    source, path = Source.parse(row["source"]), None
    if not source.remote:
        at = os.path.realpath(source.resolve(home))
        own = at.startswith(os.path.realpath(os.path.join(home, "archive")) + os.sep)
        used = any(r["id"] != crawl and r["source"] == row["source"] for r in manifest.rows.values())
        path = at if own and not used and os.path.exists(at) else None
    return {"id": crawl, "name": row["name"], "collection": row["collection"], "file": path, "last_in_collection": len(manifest.members(row["collection"])) == 1}


def delete_crawl(spark: SparkSession, home: str, crawl: str) -> dict:
    """Documents first, then files, the manifest's row last: a run that breaks off can be run again."""
    plan = plan_crawl_deletion(spark, home, crawl)
    maintain.delete_crawl(spark, home, crawl)
    if plan["file"]:
        os.remove(plan["file"])
        with contextlib.suppress(OSError):  # not empty
            os.rmdir(os.path.dirname(plan["file"]))
    finding_aids.forget_crawl(spark, home, plan["collection"], crawl)
    Manifest.open(spark, home).remove(crawl)
    return plan


def plan_collection_deletion(spark: SparkSession, home: str, collection: str) -> dict:
    known = {c["id"] for c in finding_aids.listed(spark, home)}
    members = Manifest.open(spark, home).members(collection)
    if collection not in known and not members:
        raise KeyError(f"no collection with the id {collection}")
    return {"id": collection, "members": [r["id"] for r in members]}


def delete_collection(spark: SparkSession, home: str, collection: str, with_crawls: bool = False) -> dict:
    """Refused while it has crawls, unless these go too; the finding aid goes last."""
    plan = plan_collection_deletion(spark, home, collection)
    if plan["members"] and not with_crawls:
        raise ValueError(f"{collection} holds {len(plan['members'])} crawls: move or delete them first, or ask for both")
    for crawl in plan["members"]:
        delete_crawl(spark, home, crawl)
    finding_aids.remove(spark, home, collection)
    return plan
