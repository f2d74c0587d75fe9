"""Exact token counts and their totals by source, language and domain.

The tokenizer is loaded once per Python worker and gets texts in Arrow batches. Counts are stored
once; totals are first made per source and only then joined, so that a source with a third of all
texts is one row, and the cube is built over those totals instead of over the records.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.parallel import spread
from claimloom.functions.text import strip

#: The tokenizer used where none is named: ranks of a public byte-level BPE for many languages.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Spellings of languages, compared in lower case. Region and script suffixes are cut before.
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "zh": "zh", "cn": "zh", "chi": "zh", "zho": "zh", "chinese": "zh", "中文": "zh", "de": "de", "ger": "de", "deu": "de", "german": "de", "deutsch": "de", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr"}

#: Codes that say that the language is not known.
UNKNOWN = ("und", "unk", "xx", "xxx")


@cache
def tokenizer(path: str):
    """The encoding of a ranks file, once per process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` with the column ``text`` replaced by ``n_tokens`` (BIGINT), the exact number of tokens.

    A NULL text counts 0, as does an empty one; a column of that name is replaced. Special tokens' strings are ordinary text.
    """
    kept = [c for c in df.columns if c not in (text, "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            # The library's own call for a list of texts only adds threads to this (1.4 times the seconds on one core).
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), n], [*kept, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), "n_tokens bigint"])
    return spread(df.select(*kept, text)).mapInArrow(count, schema)


def language(x: Column) -> Column:
    """One code per language: a known spelling's, else the primary part of any well-formed code (two or
    three letters, perhaps with further parts), in lower case.

    'unknown' stands for missing and blank values, for the codes UNKNOWN, and for what is no code. Codes of
    two and of three letters are one only where LANGUAGES says so.
    """
    x = F.translate(F.lower(strip(x)), "_", "-")
    names = F.create_map(*(F.lit(v) for pair in LANGUAGES.items() for v in pair))
    primary = F.nullif(F.regexp_extract(x, "^([a-z]{2,3})(-[a-z0-9]{1,8})*$", 1), F.lit(""))
    return F.coalesce(F.try_element_at(names, x), F.try_element_at(names, primary), F.when(~primary.isin(*UNKNOWN), primary), F.lit("unknown"))


def token_cube(counts: DataFrame) -> DataFrame:
    """Totals over every subset of ``source, language, domain`` per ``table_name``.

    ``counts`` has those columns, ``n_records`` and ``n_tokens``. NULL in a dimension stands for all
    its values; ``level`` has a bit for each dimension so totalled (4 source, 2 language, 1 domain).
    A missing source or domain is 'unknown'.
    """
    named = counts.select("table_name", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("source", "language", "domain")), "n_records", "n_tokens")
    base = named.groupBy("table_name", "source", "language", "domain").agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    level = (F.grouping("source") * 4 + F.grouping("language") * 2 + F.grouping("domain")).cast("int")
    # The table is always kept: a cube over the other three, with the table as part of each set.
    sets = [[c for c, bit in (("source", 4), ("language", 2), ("domain", 1)) if not mask & bit] for mask in range(8)]
    totals = base.groupingSets([["table_name", *s] for s in sets], "table_name", "source", "language", "domain")
    return totals.agg(level.alias("level"), F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))


def stored_counts(sections: DataFrame, documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``table_name, record_id, source, language, domain, n_tokens`` of every record, written once.

    Sections carry their source_id as source and no language or domain yet. A section delivered more
    than once appears once (only its id and count are shuffled for that); sections and documents without
    an id are left out. Documents' repository names
    are compared without case and surrounding white space.
    """
    s = token_counts(sections.where("section_id IS NOT NULL").select("section_id", "source_id", "text"), "text", path).groupBy("section_id").agg(F.max("source_id").alias("source"), F.max("n_tokens").alias("n_tokens"))
    s = s.select(F.lit("source_sections").alias("table_name"), F.col("section_id").alias("record_id"), "source", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("domain"), "n_tokens")
    d = token_counts(documents.where("doc_id IS NOT NULL").select("doc_id", "source", "lang", "domain", "text"), "text", path)
    d = d.select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_id"), F.nullif(F.lower(strip("source")), F.lit("")).alias("source"), language(F.col("lang")).alias("language"), "domain", "n_tokens")
    return written(s.unionByName(d), "tokens")


def token_budget(sections: DataFrame, sources: DataFrame, documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The token cube of sections (through their source) and documents."""
    counts = stored_counts(sections, documents, path)
    sums = (F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    of_sources = sources.groupBy("source_id").agg(F.max("language").alias("language"), F.max("subject_domain").alias("domain"))
    by_source = counts.where("table_name = 'source_sections'").groupBy("table_name", "source").agg(*sums)
    s = by_source.join(of_sources, by_source.source == of_sources.source_id, "left").select("table_name", "source", language(F.col("language")).alias("language"), "domain", "n_records", "n_tokens")
    d = counts.where("table_name = 'documents'").groupBy("table_name", "source", "language", "domain").agg(*sums)
    return token_cube(s.unionByName(d))
