"""Text functions without a built-in form, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_THOUGHT = re.compile(r"<think>.*?</think>", re.DOTALL)


def _plain(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").lower()
    return "".join(c for c in folded if not c.isspace() and unicodedata.category(c)[0] not in "PSC")


@pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """NFKC in lower case, without white space, punctuation, symbols and control characters; null is empty."""
    return texts.map(_plain)


def _hash(text: str | None) -> str | None:
    try:
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    except (TypeError, ValueError):
        return None


@pandas_udf(StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """16 hex digits of a JSON text's hash, whatever the order of its keys and its white space; null if it is no JSON."""
    return texts.map(_hash)


def _last_object(text: str | None) -> str | None:
    decoder, found, at = json.JSONDecoder(), None, 0
    text = _THOUGHT.sub("", text or "")
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        found, at = json.dumps(value, ensure_ascii=False), end
    return found


@pandas_udf(StringType())
def last_json_object(texts: pd.Series) -> pd.Series:
    """The last JSON object that isn't within another one, without thoughts around it; null if there is none."""
    return texts.map(_last_object)
