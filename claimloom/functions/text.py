"""Text expressions that mean the same in Spark and in the SQL they are checked against.

White space is the class that Python's ``\\s`` has over the basic plane; Spark's own ``\\s`` and
``trim`` know only ASCII. Everything here is a plain column expression, but for :func:`nfc` 
:func:`unaccent`, :func:`normalise` and :func:`runs`, which handle whole Arrow arrays.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space code points, as a regular expression class valid in Java and RE2.
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
_SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: The dashes that fold to the ASCII hyphen.
DASHES = "‐‑‒–—―"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without leading and trailing white space; NULL stays NULL."""
    return F.regexp_replace(col(x), f"^{WS}+|{WS}+$", "")


def trimmed(x: Column | str) -> Column:
    """As :func:`strip`; the regular expression runs only on texts that begin or end with white space, which makes it many times faster over others."""
    x = col(x)
    return F.when(F.substring(x, 1, 1).isin(*_SPACES) | F.substring(x, -1, 1).isin(*_SPACES), strip(x)).otherwise(x)


def collapse(x: Column | str) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(col(x), f"{WS}+", " ")


def fold_dashes(x: Column | str) -> Column:
    return F.translate(col(x), DASHES, "-" * len(DASHES))


def _composed(texts: pa.Array) -> pa.Array:
    """NFC by Python's tables: Arrow's own kernel leaves letters decomposed in the version at hand."""
    return pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFC", s) for s in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode NFC, for which Spark has no function."""
    return _composed(texts)


@F.arrow_udf(StringType())
def unaccent(texts: pa.Array) -> pa.Array:
    """Without combining marks (NFD, drop category Mn, back to NFC)."""
    return _composed(pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFD"), r"\p{Mn}+", ""))


@F.arrow_udf(StringType())
def _normal(texts: pa.Array) -> pa.Array:
    flat = pc.replace_substring_regex(_composed(texts), f"{WS}+", " ")
    return pc.utf8_trim(pc.replace_substring_regex(flat, f"[{DASHES}]", "-"), " ")


def normalise(x: Column | str) -> Column:
    """The form in which quotes are compared: NFC, white space collapsed, dashes folded, stripped."""
    return _normal(col(x))


@F.arrow_udf(StringType())
def _spaced(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"([\x{2e80}-\x{9fff}\x{f900}-\x{faff}]+)", r" \1 ")


def runs(x: Column | str) -> Column:
    """Runs of Chinese characters and runs of others, of a text whose only white space are blanks; an array."""
    return F.array_remove(F.split(_spaced(col(x)), " "), "")


def words(x: Column | str) -> Column:
    """The words between white space; an empty text has none."""
    return F.filter(F.split(collapse(strip(x)), " "), lambda w: F.length(w) > 0)


def blank(x: Column | str) -> Column:
    """True where the value is NULL or only white space."""
    return F.coalesce(strip(x), F.lit("")) == ""


def key(x: Column | str) -> Column:
    """A key for comparison: case and surrounding white space do not matter; blank is NULL."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def instant_us(x: Column | str) -> Column:
    """Microseconds since 1970 of an ISO-8601 string in any spelling; NULL where it is none."""
    return F.unix_micros(col(x).try_cast("timestamp"))
