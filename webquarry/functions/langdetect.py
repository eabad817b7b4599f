"""Guess of a page's language where it declares none: scripts first, then stop words; none unless clear.

Only texts of 40 bytes and more are judged, by their first 2 KiB.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_BYTES, SAMPLE_BYTES = 40, 2048

#: Languages whose script alone decides, by code point range.
SCRIPTS = [
    (0x0370, 0x03FF, "el"), (0x0530, 0x058F, "hy"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0900, 0x097F, "hi"),
    (0x0980, 0x09FF, "bn"), (0x0A00, 0x0A7F, "pa"), (0x0A80, 0x0AFF, "gu"), (0x0B00, 0x0B7F, "or"), (0x0B80, 0x0BFF, "ta"),
    (0x0C00, 0x0C7F, "te"), (0x0C80, 0x0CFF, "kn"), (0x0D00, 0x0D7F, "ml"), (0x0D80, 0x0DFF, "si"), (0x0E00, 0x0E7F, "th"),
    (0x1000, 0x109F, "my"), (0x10A0, 0x10FF, "ka"), (0x1200, 0x137F, "am"), (0x1780, 0x17FF, "km"), (0x3040, 0x30FF, "ja"),
    (0xAC00, 0xD7AF, "ko"), (0x4E00, 0x9FFF, "zh"),
]
#: Frequent words of languages that share a script.
WORDS = {
    "en": "the of and to in is that it for was on with as be at by this are from or an have not which you",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le",
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas avec ce il",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "it": "di che e la il un a è per in una sono con del si da non le al dei come della più gli",
    "pt": "de que e o a do da em um para com não uma os no se na por mais as dos como mas ao",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag",
    "da": "og i at det er en til af på som for med de ikke den har der et han men var jeg",
    "pl": "i w na z że się do nie to jest o jak za od po przez ale co tak jego dla",
    "ru": "и в не на что я с он как это по но они к у из за от так его для",
    "uk": "і в не на що я з він як це по але вони до у із за від так його для",
}
_lookup: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in _words.split():
        _lookup.setdefault(_w, []).append(_lang)
_word = re.compile(r"[^\W\d_]+")


@cache
def _script(c: str) -> str | None:
    """Language of a letter's script, blank if several share it; None for what is no letter."""
    return next((lang for a, b, lang in SCRIPTS if a <= ord(c) <= b), "") if c.isalpha() else None


def detect(text: str | None) -> str | None:
    text = (text or "").strip()
    if len(text.encode()) < LEAST_BYTES:
        return None
    text = text.encode()[:SAMPLE_BYTES].decode("utf-8", "ignore")
    letters, scripts = 0, Counter()
    for c, n in Counter(text).items():
        if (lang := _script(c)) is not None:
            letters += n
            scripts[lang] += n
    if not letters:
        return None
    if scripts["ja"] and scripts["ja"] + scripts["zh"] > letters / 2:
        return "ja"
    lang, n = scripts.most_common(1)[0]
    if lang and n > letters / 2:
        return lang
    words = _word.findall(text.lower())
    votes = Counter(x for w in words for x in _lookup.get(w, ()))
    ranked = votes.most_common(2)
    if not ranked or ranked[0][1] < max(2, len(words) / 12):
        return None
    return ranked[0][0] if len(ranked) == 1 or ranked[0][1] >= 1.25 * ranked[1][1] else None


def detected(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(detect)

    return run(F.col(text) if isinstance(text, str) else text)
