"""Language by ranked trigrams: profiles learned from texts whose language is declared, and a margin below which none is told.

A text's profile is its most frequent trigrams in order. Its distance from a language's profile is how far each of its
trigrams stands from its place there, PLACES where it isn't there at all. The nearest language is told if the next one
is farther by a margin. Profiles are made by one aggregation over all declared texts, so the languages known are those
that the archive declares; they are PLACES rows a language and live as a small file beside the index.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.functions.scalars import byte_prefix
from webquarry.sources.files import Store

#: Trigrams of a profile, bytes of a text that are looked at, and the margin in parts of the nearest distance: 1 in MARGIN.
PLACES, SAMPLE, LEAST, MARGIN = 300, 2048, 40, 50
NAME = "languages.json"
WORD = r"\p{L}+"
_word = regex.compile(WORD)


def trigrams(text: Column | str) -> Column:
    """All trigrams of the words of a text's sample, each word between two blanks."""
    sample = F.lower(byte_prefix(text, SAMPLE))
    words = F.transform(F.regexp_extract_all(sample, F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def learned(texts: DataFrame) -> DataFrame:
    """lang, gram, place (from 0): texts has text and lang, and rows without a language are left out. Two partial aggregations, no text is moved."""
    grams = texts.where("lang is not null and lang <> ''").select("lang", F.explode(trigrams("text")).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return grams.withColumn("place", place).where(F.col("place") < PLACES).select("lang", "gram", "place")


def table(profiles: DataFrame) -> dict[str, dict[str, int]]:
    """Profiles for the tasks: PLACES rows for each language."""
    out: dict[str, dict[str, int]] = {}
    for r in profiles.collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["place"]
    return out


def save(spark: SparkSession, home: str, profiles: dict[str, dict[str, int]]) -> None:
    Store(spark, home).put(NAME, json.dumps(profiles, ensure_ascii=False, sort_keys=True))


def load(spark: SparkSession, home: str) -> dict[str, dict[str, int]]:
    text = Store(spark, home).read(NAME)
    return json.loads(text) if text else {}


def learn(spark: SparkSession, home: str, documents: DataFrame) -> dict[str, dict[str, int]]:
    """Profiles from documents (body, lang) into the home, where ingest finds them."""
    found = table(learned(documents.select(F.col("body").alias("text"), "lang")))
    save(spark, home, found)
    return found


def own_profile(text: str) -> list[str]:
    """The PLACES most frequent trigrams of a sample, ties by code point."""
    grams = Counter(w[i : i + 3] for w in (f" {w} " for w in _word.findall(text.lower())) for i in range(len(w) - 2))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:PLACES]]


def told(texts: Column | str, profiles: dict[str, dict[str, int]]) -> Column:
    """The language of each text, null where it is short, has no letters or none is nearer than the rest by the margin."""
    langs = sorted(profiles)
    grams = sorted({g for p in profiles.values() for g in p})
    number = {g: k for k, g in enumerate(grams)}
    where = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        for g, place in profiles[lang].items():
            where[number[g], j] = place

    @F.pandas_udf("string")
    def run(samples: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or len(text.encode()) < LEAST or not langs:
                return None
            own = own_profile(text)
            if not own:
                return None
            at = where[[number.get(g, len(grams)) for g in own]]
            far = np.where(at < 0, PLACES, np.abs(at - np.arange(len(own))[:, None])).sum(0)
            order = np.argsort(far, kind="stable")  # ties: the lesser name
            if len(langs) > 1 and (far[order[1]] - far[order[0]]) * MARGIN < far[order[0]]:
                return None
            return langs[order[0]] if far[order[0]] < PLACES * len(own) else None

        return samples.map(one)

    return run(byte_prefix(texts, SAMPLE))
