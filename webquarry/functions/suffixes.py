"""Registrable domains by the public suffix list, private suffixes included.

The list is the one on Spark's own class path; its size is fixed (some ten thousand rules), so it is
broadcast. Hosts are resolved in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RESOURCE = "mozilla/public-suffix-list.txt"
_rules: frozenset[str] | None = None


def rules(spark: SparkSession) -> frozenset[str]:
    """Rules as they stand in the list: `com`, `*.ck`, `!www.ck`."""
    global _rules
    if _rules is None:
        jvm = spark._jvm
        stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(RESOURCE)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        _rules = frozenset(s.split()[0].lower() for line in text.splitlines() if (s := line.strip()) and not s.startswith("//"))
    return _rules


def registrable(host: str | None, known: frozenset[str]) -> str:
    """The suffix and one label more; empty for a suffix itself, an address or nothing."""
    host = (host or "").lower().strip(".")
    labels = host.split(".")
    if not host or "" in labels or re.fullmatch(r"[\d.]+|\[.*\]", host):
        return ""
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        if "!" + name in known:
            return ".".join(labels[i:])
        if name in known or ("*." + ".".join(labels[i + 1 :]) in known and i + 1 < len(labels)):
            return ".".join(labels[i - 1 :]) if i else ""
    return ".".join(labels[-2:]) if len(labels) > 1 else ""


def site(spark: SparkSession, host: Column | str) -> Column:
    """Column of registrable domains."""
    shared = spark.sparkContext.broadcast(rules(spark))

    @F.pandas_udf("string")
    def run(hosts: pd.Series) -> pd.Series:
        known = shared.value
        return hosts.map({h: registrable(h, known) for h in hosts.unique()})

    return run(F.col(host) if isinstance(host, str) else host)
