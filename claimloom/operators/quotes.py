"""Matching quotes to the texts they were taken from.

The cascade is exact, then normalised, then ambiguous (five words or more of which over 80 % occur),
else not found; the first occurrence counts. Texts are normalised once, before any join, and move once:
to the quotes that are to be compared with them, which equi-joins find (the located section, or within
the source a word that the quote and the section must have in common).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.parallel import spread
from claimloom.functions.text import normalise, runs, words
from claimloom.operators.containment import substrings

#: Fixed value: the share of words above which a quote without a match is ambiguous, and the fewest words for it.
SHARE, FEWEST = 0.8, 5


def word_share(quote_words: Column, lower_text: Column) -> Column:
    """The share of words that occur in the text as substrings, in lower case; NULL without words."""
    return F.try_divide(F.size(F.filter(quote_words, lambda w: F.contains(lower_text, F.lower(w)))), F.size(quote_words))


def cascade(quote: str, text: str, norm_quote: str, norm_text: str, lower_text: str | None = None) -> Column:
    """``struct(status, start, end)``; offsets are in the text, or for 'normalised' in the normalised text.

    NULL quotes and NULL texts are not found; an empty quote is found at 0. ``lower_text`` is the normalised
    text in lower case, where it is at hand.
    """
    found = lambda status, t, q: F.struct(F.lit(status).alias("status"), (F.instr(F.col(t), F.col(q)) - 1).alias("start"), (F.instr(F.col(t), F.col(q)) - 1 + F.length(q)).alias("end"))
    none = lambda status: F.struct(F.lit(status).alias("status"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    w = words(norm_quote)
    return (
        F.when(F.length(quote) == 0, F.struct(F.lit("exact").alias("status"), F.lit(0).alias("start"), F.lit(0).alias("end")))
        .when(F.contains(text, quote), found("exact", text, quote))
        .when(F.contains(norm_text, norm_quote), found("normalised", norm_text, norm_quote))
        .when((F.size(w) >= FEWEST) & (word_share(w, F.col(lower_text) if lower_text else F.lower(norm_text)) > SHARE), none("ambiguous"))
        .otherwise(none("not_found"))
    )


def with_normal(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, normalise(text))


def readied(sections: DataFrame) -> DataFrame:
    """Sections with ``nt``, the normalised text, written once."""
    return sections if "nt" in sections.columns else written(with_normal(spread(sections), "text", "nt"), "normal")


def asking(claims: DataFrame) -> DataFrame:
    """``claim_id, source_id, source_quote, nq`` of claims, written once."""
    return claims if "nq" in claims.columns else written(with_normal(spread(claims.select("claim_id", "source_id", "source_quote")), "source_quote", "nq"), "quotes")


def located(claims: DataFrame, locators: DataFrame, sections: DataFrame) -> DataFrame:
    """``claim_id, source_id, section_id, page, status, start, end`` of each claim against its located section.

    Claims without a locator, a section or a text are not found there. Inputs hold each record once.
    """
    c, s = asking(claims), readied(sections.select("section_id", *(x for x in ("text", "nt") if x in sections.columns)))
    at = c.join(locators.select("claim_id", "section_id", "page"), "claim_id", "left")
    rows = at.join(s.select("section_id", "text", "nt", F.lower("nt").alias("lt")), "section_id", "left").withColumn("m", cascade("source_quote", "text", "nq", "nt", "lt"))
    return rows.select("claim_id", "source_id", "section_id", "page", "m.status", "m.start", "m.end")


def hits_in_source(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """``claim_id, section_id, sequence_number, kind``: all sections of its source that have the quote, exactly (0) or normalised (1).

    A quote that occurs has all its inner words (those bounded within the quote, by blanks or a change
    to or from Chinese characters) as words of the section, so the rarest of them is the join key, together
    with the source. A quote of one or two words has none; its longest word is then part of a word of
    the section, and is looked for among the distinct words of the source.
    """
    c = asking(claims).where("nq <> ''")
    w = c.select("claim_id", "source_id", runs("nq").alias("w"))
    inner = written(w.select("claim_id", "source_id", F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)).alias("inner"), F.array_max(F.transform("w", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"].alias("longest")), "inner")
    s = readied(sections)
    listed = written(s.select("source_id", "section_id", runs("nt").alias("w")).select("source_id", "section_id", F.explode(F.array_distinct("w")).alias("word")), "words")
    asked = inner.where("inner IS NOT NULL").select("claim_id", "source_id", F.explode("inner").alias("word"))
    often = listed.groupBy("source_id", "word").agg(F.count("*").alias("n"))
    # The words of one quote are few: their least is taken of a list, without a sort of all rows.
    least = F.array_min(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("word"))))
    rarest = asked.join(often, ["source_id", "word"], "left").groupBy("claim_id", "source_id").agg(least.alias("x")).where("x.n > 0").select("claim_id", "source_id", "x.word")
    pairs = rarest.join(listed, ["source_id", "word"]).select("claim_id", "section_id")
    short = inner.where("inner IS NULL AND longest IS NOT NULL AND source_id IS NOT NULL").select("claim_id", "source_id", F.col("longest").alias("word"))
    if not short.isEmpty():
        there = listed.join(short.select("source_id").distinct(), "source_id", "left_semi")
        parts = substrings(short.select("source_id", "word").distinct(), there.select("source_id", F.col("word").alias("token")).distinct(), ("source_id",))
        among = parts.join(there.withColumnRenamed("word", "token"), ["source_id", "token"]).select("source_id", "word", "section_id").distinct()
        pairs = pairs.unionByName(short.join(among, ["source_id", "word"]).select("claim_id", "section_id"))
    tried = pairs.join(c.select("claim_id", "source_quote", "nq"), "claim_id").join(s.select("section_id", "sequence_number", "text", "nt"), "section_id")
    kind = F.when(F.contains("text", "source_quote"), 0).when(F.contains("nt", "nq"), 1)
    return tried.select("claim_id", "section_id", "sequence_number", kind.alias("kind")).where("kind IS NOT NULL")


def in_source(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """``claim_id, section_id, sequence_number, status``: the first section of its source that has the quote, exactly or normalised."""
    best = hits_in_source(claims, sections).groupBy("claim_id").agg(F.min(F.struct("kind", "sequence_number", "section_id")).alias("b"))
    return best.select("claim_id", "b.section_id", "b.sequence_number", F.when(F.col("b.kind") == 0, "exact").otherwise("normalised").alias("status"))


def partly_in_source(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """``claim_id`` of quotes of five words or more, over 80 % of which stand somewhere in their source.

    For claims without another match. A word has no white space, so it stands in its source exactly if it
    is one of the source's distinct tokens, or a part of one; repeats of a word count each time.
    """
    c = asking(claims).select("claim_id", "source_id", F.transform(words("nq"), F.lower).alias("w")).where((F.size("w") >= FEWEST) & F.col("source_id").isNotNull())
    wanted = c.select("source_id", F.explode("w").alias("word")).distinct()
    s = readied(sections).join(c.select("source_id").distinct(), "source_id", "left_semi")
    tokens = written(s.select("source_id", F.explode(F.array_distinct(F.split(F.lower("nt"), " "))).alias("token")).where("token <> ''").distinct(), "tokens")
    whole = F.col("token").isNotNull().alias("found")
    looked = written(wanted.join(tokens.withColumn("word", F.col("token")), ["source_id", "word"], "left").select("source_id", "word", whole), "looked")
    rest = looked.where("NOT found").select("source_id", "word")
    parts = substrings(rest, tokens, ("source_id",)).select("source_id", "word").distinct()
    there = looked.where("found").select("source_id", "word").unionByName(parts)
    n = c.select("claim_id", "source_id", F.size("w").alias("size"), F.explode("w").alias("word")).join(there, ["source_id", "word"]).groupBy("claim_id", "size").agg(F.count("*").alias("n"))
    return n.where(F.col("n") / F.col("size") > SHARE).select("claim_id")
