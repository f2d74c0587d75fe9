"""One form for texts that look the same, computed by DuckDB inside Arrow partitions.

The SQL maps compatibility forms, blanks, hyphens and look-alike letters by ``translate`` (one
character) and ``replace`` (several), takes out invisible characters by a regular expression, and
composes accents with ``nfc_normalize``. Of the large tables, which are built by rule from the Unicode
data, each Arrow batch uses only the characters that occur in it. Letters that differ to the eye
(superscripts, subscripts, fractions, circled ones, a long s) stay as they are, as do tabs, case and the
number of punctuation marks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts (Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, phonetic) and the Latin ones of the same case that they look like.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТХУӀҮԌԚԜѴаеорсухѕіјһӏԁԛԝѵ", "ABESIJKMHOPCTXYIYGQWVaeopcyxsijhldqwv"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹονϳϲ", "ABEZHIKMNOPTYXJCovjc"),
    ("ՕՏՍԼօոսհցյզ", "OSULonuhgjq"),
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲥ", "HIKMNOPCTXoc"),
    ("ɡ", "g"),
)
#: Hyphens that look like the ASCII one; the unassigned place of the italic h, which is elsewhere.
OTHERS = {"‐": "-", "‑": "-", "﹣": "-", "\U0001d455": "h"}
#: Kinds of decomposition whose look differs from that of what they decompose to, and a letter of that sort.
DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>", "<vertical>")
UNLIKE = "ſ"
#: What cannot be seen, as a regular expression class.
INVISIBLE = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0001}-\x{e007f}\x{e0100}-\x{e01ef}]"
#: Characters that one subquery replaces by several.
STEP = 64


@cache
def _alike() -> dict[str, str]:
    return {x: y for xs, ys in LOOK_ALIKES for x, y in zip(xs, ys, strict=True)} | OTHERS


def _marks(s: str) -> int:
    return sum(unicodedata.category(c).startswith("P") for c in s)


def looks(c: str) -> str:
    """What a character looks like, by one step of its decomposition after another.

    It stays itself where a step changes the look (superscripts and the like, Greek symbol variants of
    letters), the number of punctuation marks (an ellipsis is one mark), or adds blanks (spacing accents).
    """
    if c in _alike():
        return _alike()[c]
    if unicodedata.category(c) == "Zs":
        return " "
    *kind, parts = unicodedata.decomposition(c).rpartition("> ")
    kind = kind[0] + ">" if kind[0] else ""
    name = unicodedata.name(c, "")
    if not parts or kind in DIFFERENT or c in UNLIKE or kind and name.startswith("GREEK") and name.endswith("SYMBOL"):
        return c
    out = unicodedata.normalize("NFC", "".join(looks(chr(int(p, 16))) for p in parts.split()))
    return c if kind and _marks(out) != _marks(c) or " " in out else out


@cache
def mapping() -> dict[str, str]:
    """Every character that is written differently and what it looks like."""
    found = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(c) or c in _alike() or unicodedata.category(c) == "Zs":
            to = looks(c)
            if to != unicodedata.normalize("NFC", c):
                found[c] = to
    return found


@cache
def mapped_class() -> str:
    """The characters of :func:`mapping` as a regular expression class of ranges."""
    points = sorted(map(ord, mapping()))
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(rows: str, present: list[str]) -> str:
    """A query that adds ``form`` to ``rows`` with ``text``, of whose mapped characters only ``present`` occur.

    Characters that become several are replaced some at a time, in one subquery after another, so that
    expressions nest no deeper however many of them there are. Texts of plain ASCII can only differ from
    their form in their line ends.
    """
    table = mapping()
    single, several = ([c for c in present if (len(table[c]) == 1) == one] for one in (True, False))
    mapped = f"translate(text, {_quoted(''.join(single))}, {_quoted(''.join(table[c] for c in single))})" if single else "text"
    query = f"SELECT *, CASE WHEN plain THEN text ELSE {mapped} END AS mapped FROM (SELECT *, regexp_full_match(text, '[\\x00-\\x7f]*') AS plain FROM {rows})"
    for at in range(0, len(several), STEP):
        mapped = "mapped"
        for c in several[at : at + STEP]:
            mapped = f"replace({mapped}, {_quoted(c)}, {_quoted(table[c])})"
        query = f"SELECT * REPLACE (CASE WHEN plain THEN mapped ELSE {mapped} END AS mapped) FROM ({query})"
    lines = "replace(mapped, chr(13) || chr(10), chr(10))"
    form = f"CASE WHEN plain THEN {lines} ELSE nfc_normalize(regexp_replace({lines}, {_quoted(INVISIBLE)}, '', 'g')) END"
    return f"SELECT * EXCLUDE (plain, mapped), {form} AS form FROM ({query})"


def _run(keys: list[str], outputs: str):
    """A partition function: DuckDB adds to each batch's keys what ``outputs`` says of ``text`` and ``form``."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            for b in batches:
                if not b.num_rows:
                    continue
                con.register("b", pa.Table.from_batches([b]))
                present = [r[0] for r in con.sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, {_quoted(mapped_class())})) AS c FROM b").fetchall()]
                out = con.sql(f"SELECT {', '.join(keys)}, {outputs} FROM ({form_sql('b', sorted(present))})").to_arrow_table()
                con.unregister("b")
                yield from out.cast(pa.schema([(n, pa.string()) for n in out.column_names])).combine_chunks().to_batches()

    return partition


def visual_forms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (strings), ``text`` and its ``form``. NULL stays NULL, '' stays ''."""
    rows = df.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(text).alias("text"))
    return rows.mapInArrow(_run(keys, "text, form"), ", ".join(f"{k} string" for k in [*keys, "text", "form"]))


def form_keys(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``form_key`` and ``text_key``: digests of form and text, so that no text is shuffled. NULL texts are left out."""
    rows = df.where(F.col(text).isNotNull()).select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(text).alias("text"))
    return rows.mapInArrow(_run(keys, "sha256(form) AS form_key, md5(text) AS text_key"), ", ".join(f"{k} string" for k in [*keys, "form_key", "text_key"]))


def look_alike_classes(keyed: DataFrame) -> DataFrame:
    """``table_name, record_id, form_key, text_key`` of records whose form is shared by another text.

    Redelivered records count once.
    """
    forms = keyed.groupBy("table_name", "form_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b")
    return keyed.join(forms.select("table_name", "form_key"), ["table_name", "form_key"], "left_semi").distinct()


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """All pairs of records with one form but different texts, by way of the pairs of texts.

    Equal texts are joined as one class, so the work grows with the pairs asked for and not with the
    square of the copies.
    """
    texts = classes.select("table_name", "form_key", "text_key").distinct()
    a, b = (texts.withColumnRenamed("text_key", k) for k in ("ka", "kb"))
    pairs = a.join(b, ["table_name", "form_key"]).where("ka < kb").drop("form_key")
    member = classes.select("table_name", "record_id", "text_key")
    for side, k in (("x", "ka"), ("y", "kb")):
        pairs = pairs.join(member.select("table_name", F.col("record_id").alias(side), F.col("text_key").alias(k)), ["table_name", k])
    return pairs.where("x <> y").select("table_name", F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()
