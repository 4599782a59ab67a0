"""Text functions of the retrieval side as column expressions, and the chunker as a pandas UDF."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word list: words too common to search for.
STOPWORDS = (
    "and", "any", "are", "ary", "but", "can", "did", "does", "for", "from", "get", "had", "has", "have", "how", "its", "may", "not",
    "our", "out", "she", "that", "the", "them", "then", "they", "this", "was", "were", "what", "when", "where", "which", "who",
    "will", "with", "would", "you", "your", "there", "their", "about", "into", "some", "such", "than", "these", "those", "here",
    "been", "being", "just", "much", "very",
)


def normalize(text: Column) -> Column:
    """Control characters and tags to blanks, one kind of line end, no runs of blanks, at most one empty line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")
    t = F.regexp_replace(t, "<[^>]{0,200}>", " ")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def stem(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & w.rlike("(s|x|z|ch|sh)es$"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def search_tokens(text: Column) -> Column:
    """Distinct stems of the words of three letters or more that are not too common, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("text:"), text), 256)


def query_fingerprint(query: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.regexp_replace(query, r"\s+", " "), "^ | $", "")), 256), 1, 12)
