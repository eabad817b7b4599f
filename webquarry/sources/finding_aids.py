"""Finding aids: a folder for each collection with README.md (front matter and narrative), crawl notes and pinned images."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from webquarry.model import COLLECTION
from webquarry.sources.files import Store

#: Fields of the front matter in the order in which they are written.
FIELDS = ("name", "created", "description", "creator", "dates", "rights", "subjects", "curator")


def split_front_matter(text: str) -> tuple[str, str]:
    """(front matter, body): without a first `---` line, or without a second one, all is body."""
    text = text.removeprefix("﻿")
    fence = re.match(r"---\r?\n", text)
    close = re.search(r"^---\r?(?:\n|\Z)", text[fence.end() :], re.MULTILINE) if fence else None
    if close is None:
        return "", text
    return text[fence.end() :][: close.start()], text[fence.end() :][close.end() :]


def _value(text: str):
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "[":
        return [_value(x) for x in text[1:].rstrip("]").split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return None if text in ("", "~", "null") else text


def front_matter(text: str) -> dict:
    """`key: value` lines and lists of `- value` lines, the part of YAML that finding aids use."""
    out: dict = {}
    last = None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and last is not None:
            out[last] = [*(out[last] if isinstance(out[last], list) else []), _value(bare[2:])]
            continue
        key, colon, value = bare.partition(":")
        if not colon or line[0].isspace():
            raise ValueError(f"malformed front matter: {line!r}")
        last = key.strip()
        out[last] = _value(value)
    return out


def parse(collection: str, text: str) -> dict:
    """A collection's row; blank fields are unset, a collection without a name goes by its id."""
    head, body = split_front_matter(text)
    found = front_matter(head)
    blank = lambda v: v.strip() or None if isinstance(v, str) else v
    subjects = found.get("subjects") or []
    row = {n: blank(found.get(n)) for n in FIELDS if n != "subjects"}
    return {"id": collection} | row | {"name": row["name"] or collection, "subjects": subjects if isinstance(subjects, list) else [subjects], "narrative": body.strip() or None}


def render(row: dict) -> str:
    """Unset fields stay as blanks to be filled in."""
    quoted = lambda v: json.dumps(v or "", ensure_ascii=False)
    lines = []
    for n in FIELDS:
        v = row.get(n)
        if n == "subjects":
            lines += [f"{n}:", *[f"- {quoted(x)}" for x in v]] if v else [f"{n}: []"]
        else:
            lines.append(f"{n}: {quoted(v)}")
    body = (row.get("narrative") or "").strip()
    return "\n".join(["---", *lines, "---", *(["", body] if body else [])]) + "\n"


def listed(spark: SparkSession, home: str) -> list[dict]:
    """All collections, by id."""
    store = Store(spark, home)
    out = []
    for name in store.names("collections"):
        if (text := store.read(f"collections/{name}/README.md")) is not None:
            out.append(parse(name, text))
    return out


def table(spark: SparkSession, home: str) -> DataFrame:
    return spark.createDataFrame([tuple(c.get(n) for n in COLLECTION.names) for c in listed(spark, home)], COLLECTION)


def write(spark: SparkSession, home: str, row: dict) -> bool:
    """Write a finding aid if that changes it."""
    store, at, text = Store(spark, home), f"collections/{row['id']}/README.md", render(row)
    if store.read(at) == text:
        return False
    store.put(at, text)
    return True


def seed(spark: SparkSession, home: str, collection: str, fields: dict) -> dict:
    """Make the collection's finding aid, or fill its gaps: what a curator wrote stays."""
    text = Store(spark, home).read(f"collections/{collection}/README.md")
    row = parse(collection, text) if text is not None else {"id": collection, "name": collection, "subjects": []}
    row |= {k: v for k, v in fields.items() if v and not row.get(k)}
    write(spark, home, row)
    return row


def remove(spark: SparkSession, home: str, collection: str) -> bool:
    return Store(spark, home).delete(f"collections/{collection}")


# ---------------------------------------------------------------- what curators add to a crawl


def _beside(collection: str, crawl: str, suffix: str) -> str:
    return f"collections/{collection}/crawls/{crawl}.{suffix}"


def note(spark: SparkSession, home: str, collection: str, crawl: str) -> str | None:
    return (Store(spark, home).read(_beside(collection, crawl, "md")) or "").strip() or None


def set_note(spark: SparkSession, home: str, collection: str, crawl: str, text: str) -> None:
    Store(spark, home).put(_beside(collection, crawl, "md"), text.strip() + "\n")


def pinned(spark: SparkSession, home: str, collection: str, crawl: str | None = None) -> str | None:
    """Path of the image pinned to a crawl, or to the collection itself."""
    at = _beside(collection, crawl, "jpg") if crawl else f"collections/{collection}/thumbnail.jpg"
    return f"{home}/{at}" if Store(spark, home).exists(at) else None


def forget_crawl(spark: SparkSession, home: str, collection: str, crawl: str) -> None:
    for suffix in ("md", "jpg"):
        Store(spark, home).delete(_beside(collection, crawl, suffix))
