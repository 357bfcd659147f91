"""The text functions as Spark expressions: Latin-script words never leave the JVM."""

from __future__ import annotations

import re
import typing
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padaflow.functions import script

_col = lambda c: F.col(c) if isinstance(c, str) else c


@lru_cache
def _mark_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters; combining marks come last, to be deleted."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if script.strip_marks(chr(c)) != chr(c)]
    single = [(c, script.strip_marks(c)) for c in letters if len(script.strip_marks(c)) == 1]
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(a for a, _ in single) + marks, "".join(b for _, b in single)


def strip_marks(c: Column | str) -> Column:
    return F.translate(_col(c), *_mark_table())


def is_devanagari(c: Column | str) -> Column:
    return _col(c).rlike(f"[{script.DEVANAGARI}]")


def is_casual(c: Column | str) -> Column:
    return _col(c).rlike(r"^[A-Za-z'\-]+$")


def fold(c: Column | str, loose: bool = False, drop: bool = True) -> Column:
    """The key of a Latin-script word, from the same steps as ``script.fold``."""
    out = _col(c)
    for kind, *args in script.fold_steps(loose, drop):
        if kind == "lower":
            out = F.lower(out)
        elif kind == "marks":
            out = strip_marks(out)
        elif kind == "text":
            out = F.replace(out, F.lit(args[0]), F.lit(args[1]))
        else:
            out = F.regexp_replace(out, args[0], re.sub(r"\\(\d)", r"$\1", args[1]))
    return out


def drop_schwa(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^(.+[^{script.VOWELS}])a$", "$1")


@F.pandas_udf(T.StringType())
def _latin(s: pd.Series) -> pd.Series:
    return s.map(script.to_latin, na_action="ignore")


def to_latin(c: Column | str) -> Column:
    """Plain words are only lowered; Devanagari and other spellings of IAST take the Arrow path."""
    return F.when(_col(c).rlike("^[a-zA-Z']*$"), F.lower(_col(c))).otherwise(_latin(_col(c)))


def strict_key(c: Column | str, drop: bool = True) -> Column:
    return fold(to_latin(c), False, drop)


def loose_key(c: Column | str, drop: bool = True) -> Column:
    return fold(to_latin(c), True, drop)


def loosen(c: Column | str) -> Column:
    return fold(c, True, True)


@F.pandas_udf(T.StringType())
def normalize_str(s: pd.Series) -> pd.Series:
    return s.map(script.normalize_str, na_action="ignore")


_ints = T.ArrayType(T.IntegerType())


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("at", _ints).add("start", _ints).add("end", _ints))
def normalize(s: pd.Series) -> pd.DataFrame:
    """``script.pieces``: a range for each character would take many times the text's memory."""
    return pd.DataFrame([script.pieces(x or "") for x in s], columns=list(script.Pieces._fields))


normalize = normalize.asNondeterministic()  # else a filter on its fields runs it a second time


def to_original(normal: Column, start: Column, end: Column) -> Column:
    """The original range of a non-empty normalised range."""

    def piece(at: Column) -> tuple[Column, Column, Column]:
        k = F.size(F.filter(normal["at"], lambda x: x <= at))
        return F.element_at(normal["start"], k), F.element_at(normal["end"], k), at - F.element_at(normal["at"], k)

    (a, b, more), (c, d, rest) = piece(start), piece(end - 1)
    return F.struct(F.when(b < 0, a + more).otherwise(a).alias("start"), F.when(d < 0, c + rest + 1).otherwise(d).alias("end"))


def transliterate(c: Column | str, to: str = "iast") -> Column:
    if to not in ("iast", "devanagari", "deva"):
        raise ValueError(f"unknown script: {to!r}")

    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: script.transliterate(x, to), na_action="ignore")

    return convert(_col(c))


def words(c: Column | str) -> Column:
    """Token texts of normalised text, in order.  Apostrophes at the ends of a word don't belong to it."""
    letter = script.LATIN.replace("'", "")
    return F.regexp_extract_all(_col(c), F.lit(f"[{script.DEVANAGARI}]+|[{letter}](?:[{script.LATIN}]*[{letter}])?"), F.lit(0))


_token = T.StructType([T.StructField(k, {str: T.StringType(), int: T.IntegerType(), bool: T.BooleanType()}[v]) for k, v in typing.get_type_hints(script.Token).items()])


@F.pandas_udf(T.ArrayType(_token))
def tokens(s: pd.Series) -> pd.Series:
    """Tokens of normalised text with offsets, segments and joinability."""
    return s.map(lambda x: [t._asdict() for t in script.tokenize(x or "")])


def surface_norm(c: Column | str) -> Column:
    return F.array_join(words(F.lower(_col(c))), " ")


def stems(c: Column | str) -> Column:
    """Stems of an undropped key, longest suffix first."""
    table, least = script.suffix_table()
    key = _col(c)
    fits = F.filter(F.array(*map(F.lit, table)), lambda s: F.endswith(key, s) & (F.length(key) - F.length(s) >= least))
    pairs = F.transform(fits, lambda s: F.substring(key, F.lit(1), F.length(key) - F.length(s)))
    both = F.flatten(F.transform(pairs, lambda b: F.array(drop_schwa(b), b)))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) >= least))


def is_suffix(c: Column | str) -> Column:
    return _col(c).isin(*script.suffix_table()[0])


def strip_suffix(c: Column | str) -> Column:
    """The key without its longest suffix, null if it has none."""
    key = _col(c)
    fits = F.filter(F.array(*map(F.lit, script.suffix_table()[0])), lambda s: F.endswith(key, s))
    return F.try_element_at(F.transform(fits, lambda s: F.substring(key, F.lit(1), F.length(key) - F.length(s))), F.lit(1))


def slug(c: Column | str) -> Column:
    key = strict_key(c, False)
    return F.when(key == "", "x").otherwise(F.lower(key))


def split_list(c: Column | str) -> Column:
    """Parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
