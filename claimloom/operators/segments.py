"""From pages to sections to blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import WS, strip
from claimloom.operators.sequences import running_count

#: Headings that open a section of a type; '&' and 'and' are one, inner white space is free.
HEADINGS = {
    "abstract": ("abstract", "摘要"),
    "introduction": ("introduction", "引言", "绪论"),
    "experimental": ("experimental", "material and method", "materials and method", "material and methods", "materials and methods", "实验", "材料与方法", "方法"),
    "results": ("results and discussion", "结果", "结果与讨论"),
    "discussion": ("discussion", "讨论"),
    "conclusion": ("conclusion", "结论", "总结"),
    "references": ("references", "参考文献", "bibliography"),
}
#: A page has text beyond so many characters; a source has few such pages below that share.
TEXT_CHARS, LOW_SHARE = 50, 0.3


def heading_type(line: Column) -> Column:
    """The type of section that a stripped line opens, else NULL."""
    kinds = F.create_map(*(F.lit(x) for kind, names in HEADINGS.items() for n in names for x in (n, kind)))
    return F.try_element_at(kinds, F.regexp_replace(F.lower(line), f"{WS}*(&|{WS}and{WS}){WS}*", " and "))


def page_headings(pages: DataFrame) -> DataFrame:
    """``source_id, page, n_chars, opens``: the last heading line of each page as ``struct(kind, heading)``, or NULL.

    Only lines that are short enough to be a heading, once stripped, are looked at.
    """
    short = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: F.length(x) < 80)
    lines = F.transform(short, lambda x: F.struct(heading_type(x).alias("kind"), x.alias("heading")))
    last = F.try_element_at(F.filter(lines, lambda x: x["kind"].isNotNull()), F.lit(-1))
    return pages.select("source_id", "page", F.length("text").alias("n_chars"), last.alias("opens"))


def sections(pages: DataFrame) -> DataFrame:
    """``source_id, section_type, heading, page_start, page_end, n_pages, n_chars``.

    ``pages`` has ``source_id, page, text``, one row per page. A page with a heading opens a section (the
    last heading of the page counts, the whole page belongs to it); pages before the first heading
    belong to none, unless the source has no heading at all and is one 'body'.
    """
    counted = running_count(page_headings(pages), ["source_id"], ["page"], F.col("opens").isNotNull(), "island")
    made = counted.groupBy("source_id", "island").agg(F.min_by("opens", "page").alias("o"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_pages"), F.sum("n_chars").alias("n_chars"))
    most = made.groupBy("source_id").agg(F.max("island").alias("most"))
    kept = made.join(most, "source_id").where("island > 0 OR most = 0")
    return kept.select("source_id", F.coalesce("o.kind", F.lit("body")).alias("section_type"), F.col("o.heading").alias("heading"), "page_start", "page_end", "n_pages", "n_chars")


def page_quality(pages: DataFrame) -> DataFrame:
    """Per source: pages, pages with text, characters, whether few pages have text, and two ratios in thousandths."""
    has = F.length("text") > TEXT_CHARS
    got = pages.groupBy("source_id").agg(F.count("*").alias("n_pages"), F.count_if(has).alias("n_with_text"), F.sum(F.length("text")).alias("n_chars"))
    share = F.col("n_with_text") / F.col("n_pages")
    return got.select("*", F.floor(F.col("n_chars") * 10 / F.col("n_pages")).cast("bigint").alias("mean_chars_x10"), (share < LOW_SHARE).alias("is_low_text"))


def without_references(text: Column) -> Column:
    """Lines that begin with a bracketed number are blanked."""
    return F.regexp_replace(text, rf"(?md)^{WS}*\[[0-9]+(?:[0-9,\-]|{WS})*\].*$", "")


def without_short_lines(text: Column) -> Column:
    """Without lines of at most three characters between their blanks."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 3), "\n")


def blocks(df: DataFrame, least: int = 50) -> DataFrame:
    """``df`` with ``block``: texts worth reading, cleaned; reference sections and texts too short are left out."""
    return df.where("section_type <> 'references'").withColumn("block", without_short_lines(without_references(F.col("text")))).where(F.length(strip("block")) >= least)


def paragraph_chunks(text: Column, most: int) -> Column:
    """Paragraphs packed to chunks of up to ``most`` characters; one longer than that stays whole.

    An array of strings; a text within the limit is one chunk, NULL has none.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        closes = (F.length(acc["cur"]) + F.length(p) > most) & (F.length(acc["cur"]) > 0)
        done = F.when(closes, F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"])
        cur = F.when(closes | (F.length(acc["cur"]) == 0), p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), cur.alias("cur"))

    folded = F.aggregate(F.split(text, "\n\n"), start, add, lambda acc: F.when(strip(acc["cur"]) != "", F.array_append(acc["done"], strip(acc["cur"]))).otherwise(acc["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(folded)


def place(text: Column, quote: Column) -> Column:
    """Where the quote begins in the text, exactly or else with all white space left out of both; -1 where it is not, or either is empty or NULL."""
    bare = lambda x: F.regexp_replace(x, f"{WS}+", "")
    exact, free = F.instr(text, quote) - 1, F.instr(bare(text), bare(quote)) - 1
    solid = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c, i: F.when(~F.regexp_like(c, F.lit(WS)), i)))
    found = F.when(exact >= 0, exact).when(free >= 0, F.coalesce(F.try_element_at(solid, free + 1), F.length(text)))
    return F.coalesce(F.when((F.length(text) > 0) & (F.length(quote) > 0), found), F.lit(-1))


def context(text: Column, start: Column, size: Column, radius: int = 240) -> Column:
    """``struct(before, after)``: up to ``radius`` characters either side of a place, stripped."""
    begin = F.greatest(start - radius, F.lit(0))
    before, after = F.substring(text, begin + 1, start - begin), F.substring(text, start + size + 1, F.lit(radius))
    return F.struct(strip(before).alias("before"), strip(after).alias("after"))
