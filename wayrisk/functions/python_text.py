"""The text functions that built-in expressions can't state exactly, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from wayrisk.sources.dimensions import ABBREVIATIONS, NO_PLACE, PLACES, PUNCTUATION


#: Letters that match an ASCII letter where case is ignored, though they have another lower case.
_FOLD = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_TOKEN = re.compile(r"\w+")


def _folded(word: str) -> str:
    return word.translate(_FOLD).lower()


def place_finder(names: list[str]):
    """A function of a text: the spans of all names in it, within one another too, by start and then the longer first.

    A text is read once, word by word: only names that begin with a word are tried there.
    """
    by_first: dict[str, list[re.Pattern]] = {}
    for n in dict.fromkeys(names):
        by_first.setdefault(_folded(_TOKEN.match(n).group()), []).append(re.compile(rf"{re.escape(n)}\b", re.IGNORECASE))

    def find(text: str) -> list[tuple[int, int]]:
        spans = set()
        for word in _TOKEN.finditer(text):
            for pattern in by_first.get(_folded(word.group()), ()):
                if hit := pattern.match(text, word.start()):
                    spans.add(hit.span())
        return sorted(spans, key=lambda s: (s[0], -s[1]))

    return find


_PLACE_ARRAY = "array<struct<text:string,start:int,end:int>>"


def places_udf(names: list[str] = PLACES):
    """A function of text: array<struct<text,start,end>> of all places named in it."""
    spans = place_finder(names)

    @F.pandas_udf(_PLACE_ARRAY)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t[a:b], "start": a, "end": b} for a, b in spans(t)] if t else [] for t in texts])

    return find


def model_places_udf(model: str = "en_core_web_sm", most: int = 1024):
    """As ``places_udf``, by a spaCy model where that library is installed (F4): places, facilities and groups in the first characters."""
    import importlib.util

    if importlib.util.find_spec("spacy") is None:
        raise ImportError("spacy isn't installed; places_udf needs nothing")

    @F.pandas_udf(_PLACE_ARRAY)
    def find(texts: pd.Series) -> pd.Series:
        import spacy

        read = spacy.load(model)
        docs = read.pipe((t or "")[:most] for t in texts)
        return pd.Series([[{"text": e.text, "start": e.start_char, "end": e.end_char} for e in d.ents if e.label_ in ("GPE", "LOC", "FAC", "NORP")] for d in docs])

    return find


def titled(names: list[str]) -> list[str]:
    """Names in title case, each once, in order."""
    return list(dict.fromkeys(n.strip().title() for n in names if n and n.strip()))


@F.pandas_udf(ArrayType(StringType()))
def unique_places(found: pd.Series) -> pd.Series:
    return found.map(lambda names: titled(list(names)) if names is not None else [])


_REJECTED = re.compile("|".join(f"(?:{p})" for p in NO_PLACE), re.IGNORECASE)
#: What is taken out of a name, in this order, and what comes instead.
_CLEANING = [(regex.compile(r"&(?:#\d+|\w+);"), " "), (regex.compile(r"\p{C}+"), ""), (regex.compile(r"\s+"), " "), (regex.compile(r"(?:'s){1,2}$"), "")]


def _could_be_place(name: str) -> bool:
    """Two characters or more, with a letter, no more than half of them digits, and none of the known other things."""
    kinds = [unicodedata.category(c)[0] for c in name]
    return len(name) > 1 and "L" in kinds and 2 * sum(map(str.isdigit, name)) <= len(name) and not _REJECTED.search(name)


def normal_place(raw: str | None) -> str | None:
    """A place's name in one form; None for what is no place."""
    name = unicodedata.normalize("NFC", raw or "")
    for pattern, instead in _CLEANING:
        name = pattern.sub(instead, name.strip())
    name = name.strip(PUNCTUATION)
    name = ABBREVIATIONS.get(name, ABBREVIATIONS.get(name.upper(), name))
    if not _could_be_place(name):
        return None
    shouted, whispered = name.isupper() and len(name) > 3, not name[0].isupper()
    return name.title() if shouted or whispered else name


@F.pandas_udf(StringType())
def normalize_place(raw: pd.Series) -> pd.Series:
    return raw.map(normal_place, na_action="ignore")


def place_or_empty(name) -> Column:
    """The normal form of a name, empty for what is no place (F8)."""
    return F.coalesce(normalize_place(name), F.lit(""))


@F.pandas_udf(ArrayType(StringType()))
def normalize_places(raw: pd.Series) -> pd.Series:
    """Normal forms, each once whatever its case."""

    def one(names):
        seen: dict[str, str] = {}
        for n in map(normal_place, names if names is not None else []):
            if n:
                seen.setdefault(n.lower(), n)
        return list(seen.values())

    return raw.map(one)


def similar(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of two headlines' first 200 characters."""
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a.lower().strip()[:200], b.lower().strip()[:200]).ratio()


@F.pandas_udf(DoubleType())
def headline_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
