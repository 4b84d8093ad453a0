"""Text normalisation shared by the operators."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space, no-break and ideographic spaces included
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trimmed(text: Column) -> Column:
    """Text without white space at either end."""
    return F.when(text.rlike(f"^{SPACE}|{SPACE}$"), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def squeezed(text: Column) -> Column:
    """Trimmed text with every run of white space as one space."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def _decoded_nfc(texts: pd.Series) -> pd.Series:
    """HTML character references decoded, then Unicode NFC."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def display_text(text: Column) -> Column:
    """A display text in comparable form: character references decoded, NFC,
    trimmed, white space collapsed. Only texts that hold a reference or
    characters beyond ASCII pass through Python."""
    needs = text.rlike(r"[^\x00-\x7F]|&")
    decoded = _decoded_nfc(F.when(needs, text))
    plain = ~needs & ~text.rlike(r"\s\s|^\s|\s$|[\t-\r]")
    return F.when(plain, text).otherwise(squeezed(F.coalesce(decoded, text)))
