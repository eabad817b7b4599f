"""Language identification with bit-sliced Bloom filters over n-grams.

Each learned language has a Bloom filter of the byte 4-grams that are characteristic of it. The filters
lie bit-sliced: row i of one table holds bit i of all languages as a mask, so the AND of a gram's rows
gives all languages that (may) contain it at once. A text's masks are summed to one count for each
language; a count is corrected for the false positives that the fill of that language's filter makes
likely, and the largest corrected share decides.

Fitting uses a bounded sample of labelled texts (`per_language`, a documented parameter, chosen by the
hash of the id); prediction reads every whole text. Text is case-folded in ASCII; digits, punctuation
and white space count as one kind of gap.

Defined results: null, empty and letterless texts give `und` with score 0; with no labelled text all
give `und`; ties go to the language first in code point order; repeated rows are predicted alike; a very
long text is judged as a whole; a null id is an id like any other (in the choice of the sample too); an empty
table gives an empty result; further columns are ignored. Grams that the sample holds once don't count (they
can't be characteristic), nor do those that are less than OWN times as frequent in a language as elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import PASS_BYTES, columns, loads, mix, passes, text_buffer, text_or_empty

GRAM, HASHES, ROWS = 4, 2, 1 << 18
#: Texts for each language, and grams for each language, that fitting uses at most (about).
PER_LANGUAGE, GRAMS = 3000, 40_000
#: A gram belongs to a language if it is at least this share as frequent there as where it is most frequent.
OWN = 0.3
#: Corrected share of grams below which a text is in none of the learned languages.
LEAST = 0.05

_fold = np.full(256, 0x20, np.uint8)
_fold[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _fold[_c] = _fold[_c - 32] = _c


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram from each byte on, as an integer, and whether it has a letter; gaps follow each text."""
    spread = np.insert(_fold[buf], np.repeat(offsets[1:], GRAM), 0x20)
    at = np.arange(len(buf)) + GRAM * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = loads(np.concatenate([spread, np.full(8, 0x20, np.uint8)]))[at]
    g = (wide & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return g, g != 0x20202020


def rows_of(g: np.ndarray, rows: int) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(0x1234567))
    return [(h >> np.uint64(s)) & np.uint64(rows - 1) for s in (0, 32)][:HASHES]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # rows x words of 64 languages, or one narrower word
    false: np.ndarray  # share of absent grams that seem present, for each language

    def shares(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of each text's grams that each language contains."""
        g, real = grams(buf, offsets)
        first, second = rows_of(g, len(self.table))
        masks = self.table[first] & self.table[second]
        masks[~real] = 0
        filled = np.diff(offsets) > 0
        at = offsets[:-1][filled]
        total = np.zeros(len(filled))
        out = np.zeros((len(filled), len(self.languages)))
        if len(at):
            total[filled] = np.add.reduceat(real.astype(np.int32), at)
            bits = 8 * self.table.dtype.itemsize
            for k in range(len(self.languages)):
                bit = (masks[:, k // bits] >> self.table.dtype.type(k % bits)) & self.table.dtype.type(1)
                out[filled, k] = np.add.reduceat(bit.astype(np.int32), at)
        n = np.maximum(total, 1)[:, None]
        return np.clip((out / n - self.false) / (1 - self.false), 0, 1)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """labelled: doc_id, text, lang. Learns from about per_language texts of each language."""
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([], np.zeros((ROWS, 1), np.uint8), np.zeros(0))
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double")
    sample = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", text_or_empty().alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                buf, offsets = text_buffer(b["text"].filter(pa.array(langs == lang)))
                g, real = grams(buf, offsets)
                value, n = np.unique(g[real], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    languages = sorted(sizes, key=lambda x: x.encode())
    counted["rate"] = counted["n"] / counted.groupby("lang")["n"].transform("sum")
    counted = counted[counted["rate"] >= OWN * counted.groupby("gram")["rate"].transform("max")]
    counted = counted.sort_values(["lang", "n", "gram"], ascending=[True, False, True]).groupby("lang").head(GRAMS)
    kind = next((t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= n), np.uint64)
    bits = 8 * np.dtype(kind).itemsize
    table = np.zeros((ROWS, -(-len(languages) // bits)), kind)
    for k, lang in enumerate(languages):
        g = counted.loc[counted["lang"] == lang, "gram"].to_numpy().astype(np.uint32)
        for r in rows_of(g, ROWS):
            table[np.unique(r), k // bits] |= kind(1 << (k % bits))
    fill = np.array([((table[:, k // bits] >> kind(k % bits)) & kind(1)).mean() for k in range(len(languages))])
    return Filters(languages, table, fill**HASHES)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score, share: for every document. share is the winner's corrected share of grams."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, "und"], object)
        for b in batches:
            buf, offsets = text_buffer(b["text"])
            shares = np.zeros((len(b), max(1, len(f.languages))))
            if f.languages:
                for i, j in passes(offsets, PASS_BYTES):
                    shares[i:j] = f.shares(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            best = shares.argmax(1)
            top, total = shares.max(1), shares.sum(1)
            lost = ~b["letters"].to_numpy(zero_copy_only=False) | (not f.languages)
            score = np.where(lost | (total == 0), 0.0, top / np.where(total == 0, 1, total))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names[np.where(lost, len(f.languages), best)], pa.string()), pa.array(score), pa.array(np.where(lost, 0.0, top))], names=["doc_id", "lang_pred", "score", "share"])

    ready = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), text_or_empty().rlike(r"\p{L}").alias("letters"))
    return ready.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, share double")


def fold_of(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents outside the fourth that is held out."""
    filters = fit(columns(docs, "doc_id", "text", "lang").where(fold_of() % 4 != 2))
    return predict(docs, filters).select("doc_id", (fold_of() % 4 == 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents written in a learned language, with all their columns: neither letterless nor foreign to all."""
    kept, spark = docs.columns, docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(columns(docs, "doc_id", "text", "lang")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            buf, offsets = text_buffer(b["text"])
            top = np.zeros(len(b))
            if f.languages:
                for i, j in passes(offsets, PASS_BYTES):
                    top[i:j] = f.shares(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).max(1)
            yield b.filter(pa.array(top >= least))

    return docs.where(text_or_empty().rlike(r"\p{L}")).mapInArrow(run, docs.schema).select(kept)
