"""Cutting long texts at natural boundaries with one regular expression.

The expression's alternatives are ordered by the strength of the boundary (end of text, paragraph,
line, sentence, clause, blank); each consumes as much as the limit allows and at least half of it,
and the last one cuts between any two characters. Spark extracts all matches as an array; the overlap
is the tail of the core before. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Single last characters of a core, strongest boundary first: the line break that ends a
#: paragraph, any line break, the blank after a sentence, a sentence's end in Chinese, the end of a clause, a blank.
ENDS = (r"(?:(?<=\n)\n|(?<=\n\r)\n)", r"\n", r"(?<=[.!?])\s", r"[。！？]", r"(?:(?<=[;:,])\s|[；：，、])", r"\s")


def pattern(max_size: int, overlap: int) -> str:
    """The expression whose matches are a text's cores: the first up to ``max_size``, later ones less the overlap."""
    if not 0 <= 2 * overlap <= max_size:
        raise ValueError("the overlap must be at most half of the size")

    def cores(most: int) -> str:
        least = min(most, max(overlap, most // 2, 1))
        return "|".join([rf".{{1,{most}}}\z", *(rf".{{{least - 1},{most - 1}}}{end}" for end in ENDS), rf".{{{most}}}"])

    return rf"(?s)(?:\A(?:{cores(max_size)})|(?:{cores(max_size - overlap)}))"


def cores(text: Column, max_size: int, overlap: int) -> Column:
    """The cores of a text: consecutive, without gap or overlap, together the text. '' has none."""
    return F.regexp_extract_all(text, F.lit(pattern(max_size, overlap)), F.lit(0))


def cut(df: DataFrame, keys: list[str], text: str, max_size: int, overlap: int) -> DataFrame:
    """``keys`` and ``cores`` of every text longer than ``max_size``."""
    return df.where(F.length(text) > max_size).select(*keys, cores(F.col(text), max_size, overlap).alias("cores"))


def pieces(df: DataFrame, keys: list[str], text: str, max_size: int, overlap: int) -> DataFrame:
    """``keys, piece_no, n_pieces, start, piece`` of every text longer than ``max_size``.

    Pieces are at most ``max_size`` code points; each but the first begins exactly ``overlap`` code
    points before the end of the one before. No core but the last is shorter than half of what it may be:
    a stronger boundary before that is passed over. Shorter, empty and NULL texts give no rows.
    """
    long = cut(df, keys, text, max_size, overlap)
    sizes = F.transform("cores", lambda c: F.length(c))
    # Running offsets in one fold over the sizes.
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    out = F.transform("cores", lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get("cores", i - 1), F.lit(overlap)), c)))
    back = long.select(*keys, F.size("cores").alias("n_pieces"), starts.alias("_starts"), F.posexplode(out).alias("piece_no", "piece"))
    return back.select(*keys, "piece_no", "n_pieces", (F.get("_starts", "piece_no") - F.when(F.col("piece_no") > 0, overlap).otherwise(0)).alias("start"), "piece")


def limit(limits: DataFrame, name: str) -> tuple[int, int]:
    """Size and overlap of one limit, from a table of a few fixed rows."""
    row = limits.where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    return row.max_size, row.overlap_size
