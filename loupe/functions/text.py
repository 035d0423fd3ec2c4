"""Text expressions (X3-X6, P13, F10-F11 building blocks).

Tokens follow the usual bag-of-words rule "lower-case runs of two or more word characters".
The word class is spelled out as ``[\\p{L}\\p{N}_]`` so that the JVM regex and DuckDB's RE2 agree
on non-ASCII letters.  Stop-word lists are the ones shipped inside Spark ML
(``StopWordsRemover.loadDefaultStopWords``), asked from the running session wherever its jars
lie; without a session they are read from the jars of SPARK_HOME or of the pyspark package.
Nothing is loaded at import.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Language code -> Spark stop-word list name; 'sv' is the fallback language.
LANGUAGES = {
    "da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french",
    "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese",
    "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish",
}
DEFAULT_LANGUAGE = "sv"


def _stop_words_of_session(name: str) -> list[str] | None:
    """The list as the running JVM has it; None without a session."""
    if SparkContext._active_spark_context is None:
        return None
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords(name)


def _stop_words_of_jars(name: str) -> list[str] | None:
    """The list from a Spark ML jar on this machine; None where there is no such jar."""
    import pyspark
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in (j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "spark-mllib_*.jar")))):
        with zipfile.ZipFile(jar) as z:
            return z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode("utf-8").split()
    return None


@functools.lru_cache(maxsize=None)
def stop_words(lang: str) -> tuple[str, ...]:
    """Spark ML's default stop words for a language code or name."""
    name = LANGUAGES.get(lang, lang)
    for source in (_stop_words_of_session, _stop_words_of_jars):
        words = source(name)
        if words:
            return tuple(dict.fromkeys(words))
    raise RuntimeError(f"no Spark session and no Spark ML jar to read the {name} stop words from")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document(*cols, null_token: str = "None") -> Column:
    """Text columns joined by a space (nulls as the reference's 'None' token)."""
    return F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit(null_token)) for c in cols])


def tokenize(c) -> Column:
    """Array of lower-cased word tokens of length >= 2, in text order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def words(c) -> Column:
    """all word tokens (length >= 1), lower-cased."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_PATTERN), 0)


def remove_stop_words(tokens, lang: str = DEFAULT_LANGUAGE, extra: tuple[str, ...] = ()) -> Column:
    """Drop stop words, keeping order and duplicates."""
    sw = F.array(*[F.lit(w) for w in (*stop_words(lang), *extra)])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(sw, t))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when shorter than n).

    Pass a materialised column: the lambda reads ``tokens`` once per element."""
    t = _c(tokens)
    if n == 1:
        return t
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens, lo: int = 1, hi: int = 1) -> Column:
    """All n-grams for lo <= n <= hi, concatenated (by n, then position)."""
    parts = [ngrams(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def hex_base64_encode(c) -> Column:
    """Each whitespace token -> b'<base64 of its lower-case utf-8 hex>' joined by spaces."""
    s = F.trim(_c(c).cast("string"))
    toks = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    enc = F.transform(toks, lambda w: F.concat(
        F.lit("b'"),
        F.regexp_replace(F.base64(F.encode(F.lower(F.hex(F.encode(w, "UTF-8"))), "UTF-8")), r"\s", ""),
        F.lit("'")))
    return F.array_join(enc, " ")


def sql_string_list(values) -> str:
    """A SQL list literal of strings (for oracles)."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
