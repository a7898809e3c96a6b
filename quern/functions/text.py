"""Codes, numbers and tokens as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Full-width forms U+FF01 to U+FF5E and the ideographic space, and what they become.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Characters counted as CJK: U+4E00 to U+9FFF.
CJK = "[一-鿿]"


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition. Pass null where it isn't needed: such rows cost nothing."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def to_halfwidth(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def normalize_code(text: Column) -> Column:
    """Half-width, without white space, upper case; empty for a null. For other compatibility forms apply ``nfkc`` first."""
    return F.upper(F.regexp_replace(to_halfwidth(F.coalesce(text, F.lit(""))), "(?U)\\s+", ""))


def normalize_barcode(text: Column) -> Column:
    return F.regexp_replace(normalize_code(text), "[^0-9A-Z]", "")


def normalize_text(text: Column) -> Column:
    """Half-width, runs of white space as one space, trimmed; the case stays."""
    return F.trim(F.regexp_replace(to_halfwidth(F.coalesce(text, F.lit(""))), "(?U)\\s+", " "))


def extract_numeric(text: Column) -> Column:
    """The number that a text is, or null: for null, empty, "--" and anything that isn't a plain decimal number."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), t.try_cast("double"))


def tokens(text: Column) -> Column:
    """Single CJK characters and neighbours two by two (across anything between), then Latin words in lower case."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_extract_all(t, F.lit(f"({CJK})"), F.lit(1))
    pairs = F.transform(F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda c, i: F.concat(F.get(cjk, i), c))
    latin = F.transform(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9]+)"), F.lit(1)), F.lower)
    return F.concat(cjk, pairs, latin)


_CJK_CHARACTER = re.compile(CJK)
#: Bytes of Latin words in lower case, others as spaces; bytes that don't begin a CJK character.
_LATIN = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in bytes(range(256)).lower())
_NO_CJK = bytes(c for c in range(256) if not 0xE4 <= c <= 0xE9)


def plain_tokens(text: str | None) -> list[bytes]:
    """``tokens`` of one text, in UTF-8."""
    raw = (text or "").encode()
    latin = raw.translate(_LATIN).split()
    if raw.isascii() or not raw.translate(None, _NO_CJK):
        return latin
    cjk = [c.encode() for c in _CJK_CHARACTER.findall(text)]
    return cjk + [a + b for a, b in zip(cjk, cjk[1:])] + latin


def token_weight(token: Column) -> Column:
    """Latin 1.6, two CJK characters 2.2, one 1.0."""
    return F.when(token.rlike("^[\\x00-\\x7F]*$"), 1.6).when(F.length(token) >= 2, 2.2).otherwise(1.0)


def estimated_tokens(text: Column) -> Column:
    """A rough count of model tokens: 1.5 CJK characters or 4 others make one; none for an empty text."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    made = F.floor(cjk / 1.5) + F.floor((F.length(text) - cjk) / 4) + 1
    return F.when(F.length(text) > 0, made).otherwise(0).cast("int")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, though loops over arrays use it: these would compute it for each element."""
    return F.get(F.transform(F.array(value), make), 0)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def trimmed(text: Column) -> Column:
    """``F.trim`` of one argument: a loop over an array would hand it the place as well, as what to trim."""
    return F.trim(text)


def sentences(text: Column) -> Column:
    """Split after 。！？；!?; (not after a full stop or a line's end), trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=[。！？；!?;])\\s*"), trimmed), lambda s: s != "")


def fixed_chunks(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Windows of ``size`` characters that overlap by ``overlap``, up to the one that reaches the end."""
    if overlap >= size:
        raise ValueError("the overlap has to be less than the size")
    step, unit = size - overlap, gcd(size, overlap)

    def cut(t):
        # Windows are joined of units of equal length: to count characters from the beginning for each takes the square of a text's length.
        last = F.greatest(F.ceil((F.length(t) - size) / step), F.lit(0)).cast("int")
        window = lambda units, k: F.trim(F.array_join(F.slice(units, k * (step // unit) + 1, size // unit), ""))
        units = F.regexp_extract_all(t, F.lit(f"(?s)(.{{1,{unit}}})"), F.lit(1))
        return bound(units, lambda u: F.transform(F.sequence(F.lit(0), last), lambda k: window(u, k)))

    return F.filter(bound(F.trim(F.coalesce(text, F.lit(""))), cut), lambda p: p != "")


def semantic_chunks(text: Column, most: int | Column = 220) -> Column:
    """Sentences joined while they fit ``most`` characters (a number, or one for each row); longer sentences are cut hard.

    The sentence that is cut ends what was gathered before it; its last part
    starts the next chunk.
    """
    most = most if isinstance(most, Column) else F.lit(most)

    def cut(s):
        places = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int"))
        return F.transform(places, lambda k: F.struct(F.substring(s, k * most + 1, most).alias("s"), (F.length(s) > (k + 1) * most).alias("hard")))

    parts = F.flatten(F.transform(sentences(text), cut))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("buf"))

    def step(a, p):
        flush = F.when(a["buf"] != "", F.array(a["buf"])).otherwise(none)
        hard = F.struct(F.concat(a["done"], flush, F.array(p["s"])).alias("done"), F.lit("").alias("buf"))
        fits = F.struct(a["done"].alias("done"), F.concat(a["buf"], p["s"]).alias("buf"))
        full = F.struct(F.concat(a["done"], flush).alias("done"), p["s"].alias("buf"))
        return F.when(p["hard"], hard).when(F.length(a["buf"]) + F.length(p["s"]) <= most, fits).otherwise(full)

    folded = F.aggregate(parts, start, step, lambda a: F.concat(a["done"], F.array(a["buf"])))
    return F.filter(F.transform(folded, trimmed), lambda c: c != "")


def hierarchical_chunks(text: Column, title: str | Column, most: int = 220) -> Column:
    """Semantic chunks that each begin with 【title】, which counts to their length; a chunk has room for 60 characters at least.

    A null or empty title is none, and puts nothing before the chunks.
    """
    title = F.coalesce(title if isinstance(title, Column) else F.lit(title), F.lit(""))
    prefix = F.when(title == "", "").otherwise(F.concat(F.lit("【"), title, F.lit("】")))
    room = F.greatest(F.lit(60), F.lit(most) - F.length(prefix))
    return F.transform(semantic_chunks(text, room), lambda c: F.concat(prefix, c))


def compressed_text(query: Column, text: Column, most: Column) -> Column:
    """The text where it fits ``most`` characters, else its sentences that share most tokens with the query, in their order, a line each.

    Sentences of fewer than six characters are left out. Sentences are taken by
    their share of the query's distinct tokens while they fit, until four fifths
    of the room are used; without any that shares a token the text is cut.
    """
    asked = F.array_distinct(tokens(query))
    parts = F.filter(sentences(text), lambda s: F.length(s) >= 6)
    share = lambda s: F.size(F.array_intersect(asked, tokens(s))) / F.greatest(F.size(asked), F.lit(1))
    ranked = F.array_sort(F.transform(parts, lambda s, i: F.struct((-share(s)).alias("k"), i.alias("i"), s.alias("s"))))
    none = F.array().cast("array<string>")

    def step(a, r):
        takes = (a["used"] < 0.8 * most) & (r["k"] < 0) & (a["used"] + F.length(r["s"]) <= most)
        taken = F.struct((a["used"] + F.length(r["s"]) + 1).alias("used"), F.concat(a["kept"], F.array(r["s"])).alias("kept"))
        return F.when(takes, taken).otherwise(a)

    kept = F.aggregate(ranked, F.struct(F.lit(0).alias("used"), none.alias("kept")), step, lambda a: a["kept"])
    joined = F.array_join(F.filter(parts, lambda s: F.array_contains(kept, s)), "\n")
    return F.when(F.length(text) <= most, text).when(F.size(kept) > 0, joined).otherwise(F.substring(text, F.lit(1), most))
