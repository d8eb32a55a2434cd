"""Text normalisation as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postlens.functions.staging import pin
from postlens.functions.fixed import (
    COMPANY_SUFFIXES,
    HTML_BLOCKS,
    HTML_LINE_TAGS,
    HTML_TAGS,
    LANGUAGE_SCRIPTS,
    LANGUAGE_WORDS,
    LOCATION_MAP,
    SCRIPT_SHARE,
    WS_CHARS,
    WS_CLASS,
)

# Entities rewritten inside the JVM. "&amp;" goes last so that its result is not read again.
_JVM_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
_OTHER_ENTITY = "&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)[#A-Za-z]"

# Characters that canonical composition leaves alone and whose category Java and Python agree on:
# Latin, basic Cyrillic, common punctuation and currency signs, CJK ideographs and Hangul syllables.
_STABLE_TEXT = "\\x00-\\u02ff\\u0400-\\u0482\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u3001-\\u3029\\u4e00-\\u9fd5\\uac00-\\ud7a3"
# Most characters are settled by the first range; the others alone are held against all of them.
_UNSTABLE = f"[\\x80-\\x{{10ffff}}&&[^{_STABLE_TEXT}]]"


def _is_odd(col: Column) -> Column:
    """Whether a text has entities beyond the common ones or characters that need Unicode composition.

    One pattern with both alternatives would try each of them at every character.
    """
    return (F.contains(col, F.lit("&")) & col.rlike(_OTHER_ENTITY)) | col.rlike(_UNSTABLE)


def _drop_controls(text: str) -> str:
    return "".join(c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C")


def _compose(text: str) -> str:
    text = unicodedata.normalize("NFC", text).replace(" ", " ").replace(" ", " ")
    return _drop_controls(text)


@F.pandas_udf(StringType())
def _unescape_any(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _compose_any(texts: pd.Series) -> pd.Series:
    return texts.map(_compose, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_compose_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _compose(html.unescape(t)), na_action="ignore")


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()``: all Unicode whitespace at both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip_ws(col) == "", F.lit(True))


def drop_tags(col: Column) -> Column:
    """Remove script and style blocks, turn block tags into newlines, drop all other tags."""
    for block in HTML_BLOCKS:
        col = F.regexp_replace(col, block, "")
    return F.regexp_replace(F.regexp_replace(col, HTML_LINE_TAGS, "\n"), HTML_TAGS, "")


def _jvm_unescape(col: Column) -> Column:
    for entity, char in _JVM_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def with_stripped_html(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: HTML to text.

    The tag-free text is its own step, so that it is computed once for its three uses. Only rows with
    entities beyond the common ones reach Python; the others send a null.
    """
    df = pin(df, _plain=F.coalesce(drop_tags(F.col(col)), F.lit("")))
    plain = F.col("_plain")
    rare = _unescape_any(F.when(plain.rlike(_OTHER_ENTITY), plain))
    return df.withColumn(out, F.coalesce(rare, _jvm_unescape(plain))).drop("_plain")


def _jvm_compose(col: Column) -> Column:
    col = F.translate(col, "  ", "  ")
    return F.regexp_replace(col, "[\\p{Cc}\\p{Cf}&&[^\\n\\t]]", "")


def clean_unicode(col: Column) -> Column:
    """Canonical composition, plain spaces, no control or invisible characters (newline and tab stay)."""
    col = F.coalesce(col, F.lit(""))
    rare = _compose_any(F.when(col.rlike(_UNSTABLE), col))
    return F.coalesce(rare, _jvm_compose(col))


def normalize_whitespace(col: Column) -> Column:
    """Tabs to spaces, no carriage returns, runs of spaces and of newlines collapsed, ends stripped."""
    col = F.translate(F.coalesce(col, F.lit("")), "\t\r", " ")
    col = F.regexp_replace(col, "  +", " ")
    col = F.regexp_replace(col, "\n\n+", "\n")
    return strip_ws(col)


def with_clean_descriptions(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add cleaned forms (tags, entities, Unicode, whitespace) of several columns, given as {column: result}.

    One Arrow pass serves the rare rows of all of them.
    """
    plain = {col: f"_plain_{i}" for i, col in enumerate(columns)}
    df = pin(df, **{name: F.coalesce(drop_tags(F.col(col)), F.lit("")) for col, name in plain.items()})
    df = df.withColumns({f"{name}_rare": _unescape_compose_any(F.when(_is_odd(F.col(name)), F.col(name))) for name in plain.values()})
    whole = {columns[col]: F.coalesce(F.col(f"{name}_rare"), _jvm_compose(_jvm_unescape(F.col(name)))) for col, name in plain.items()}
    df = df.withColumns({out: normalize_whitespace(value) for out, value in whole.items()})
    return df.drop(*plain.values(), *[f"{name}_rare" for name in plain.values()])


def with_clean_description(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: tags, entities, Unicode and whitespace cleaned, with one Arrow pass for the rare rows."""
    return with_clean_descriptions(df, {col: out})


def _capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000_000)))


def normalize_company(col: Column) -> Column:
    """Drop company-form suffixes; keep all-caps words, capitalize the others."""
    col = F.regexp_replace(strip_ws(F.coalesce(col, F.lit(""))), f"{WS_CLASS}+", " ")
    for suffix in COMPANY_SUFFIXES:
        col = F.regexp_replace(col, f"(?iU){suffix}", "")
    words = F.filter(F.split(col, f"{WS_CLASS}+"), lambda w: w != "")

    def shape(word: Column) -> Column:
        all_caps = (F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word))
        return F.when(all_caps, word).otherwise(_capitalize(word))

    return F.array_join(F.transform(words, shape), " ")


def title_case(col: Column) -> Column:
    """Python ``str.title()``: a capital after every character that has no case (``initcap`` knows blanks only)."""
    runs = F.split(F.lower(col), "(?<=[^\\p{Lu}\\p{Ll}\\p{Lt}])")
    return F.array_join(F.transform(runs, _capitalize), "")


def normalize_location(col: Column) -> Column:
    """Known place names to their region, everything else in title case."""
    place = F.lower(strip_ws(F.coalesce(col, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in LOCATION_MAP.items() for x in pair])
    return F.coalesce(F.try_element_at(known, place), title_case(place))


def with_language(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: the language of the script that a good share of the letters has, or else the one with the most
    profile words, 'unknown' without any.

    Ties go to the first language code. The text is split once and only words of some profile are kept, so
    the count per language runs over a short array.
    """
    known = sorted({word for profile in LANGUAGE_WORDS.values() for word in profile})
    words = F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), "[^\\p{L}]+")

    def score(lang: str) -> Column:
        hits = F.size(F.filter(F.col("_known"), lambda w: w.isin(LANGUAGE_WORDS[lang])))
        return F.struct((-hits).alias("n"), F.lit(lang).alias("lang"))

    scored = pin(df, _known=F.filter(words, lambda w: w.isin(known)))
    best = F.array_min(F.array(*[score(lang) for lang in LANGUAGE_WORDS]))
    ranked = pin(scored, _best=best)
    text = F.coalesce(F.col(col), F.lit(""))
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    found = F.when(F.col("_best.n") < 0, F.col("_best.lang")).otherwise("unknown")
    for lang, script in sorted(LANGUAGE_SCRIPTS.items(), reverse=True):
        of_script = F.when(F.rlike(text, F.lit(f"\\p{{Is{script}}}")), F.regexp_count(text, F.lit(f"\\p{{Is{script}}}"))).otherwise(0)
        found = F.when((of_script > 0) & (of_script >= SCRIPT_SHARE * letters), lang).otherwise(found)
    return ranked.withColumn(out, found).drop("_known", "_best")
