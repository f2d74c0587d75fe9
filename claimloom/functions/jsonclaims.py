"""Reading model answers: JSON objects with ``claims``, or bare arrays, perhaps fenced or cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import blank, strip
from claimloom.operators.validation import CLAIM_TYPES, REQUIRED


def without_fence(x: Column) -> Column:
    """The inside of a Markdown code fence around the whole text, else the text; both stripped."""
    x, fence = strip(x), F.lit("```")
    inner = F.substring(x, F.lit(4), F.length(x) - 6)
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, F.lit(5), F.length(inner))).otherwise(inner)
    return F.when(F.startswith(x, fence) & F.endswith(x, fence) & (F.length(x) >= 6), strip(inner)).otherwise(x)


def closed(x: Column) -> Column:
    """With as many closing braces appended as are missing by count."""
    missing = F.length(F.regexp_replace(x, "[^{]", "")) - F.length(F.regexp_replace(x, "[^}]", ""))
    return F.when(missing > 0, F.concat(x, F.repeat(F.lit("}"), missing))).otherwise(x)


def balanced(x: Column) -> Column:
    """True if every bracket outside of strings is closed and nothing follows the value; parsers stop at its end."""
    bare = F.regexp_replace(x, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')
    n = lambda c: F.length(F.regexp_replace(bare, f"[^\\{c}]", ""))
    return (n("{") == n("}")) & (n("[") == n("]")) & ~bare.rlike(r"[}\]]\s*[^\s,}\]]")


def parse_answers(df: DataFrame, raw: str, required: tuple[str, ...] = REQUIRED, bare: bool = False) -> DataFrame:
    """``df`` with ``status`` (ok, empty, invalid_json, invalid_schema), ``claims``, ``n_claims`` and ``n_errors``.

    A claim is good if its four required strings are not blank and its type is in the domain. Blank and
    NULL answers are empty, with one error. An answer that cannot be read is tried once more with its
    missing braces appended. Elements that are no objects are errors of their own. With ``bare``, an
    object without ``claims`` is itself a claim.
    """
    text = without_fence(F.col(raw))
    whole = lambda x: F.when(balanced(x), F.try_parse_json(x))
    rows = df.withColumn("_t", text).withColumn("_v", F.coalesce(whole(F.col("_t")), whole(closed(F.col("_t")))))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    rows = rows.withColumns({"_kind": F.schema_of_variant("_v"), "_claims": kind("$.claims")})
    is_list = F.col("_kind").startswith("ARRAY")
    has_list = F.col("_claims").startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get("_v", "$", "array<variant>")).when(has_list, F.try_variant_get("_v", "$.claims", "array<variant>")).when(F.lit(bare) & F.col("_kind").startswith("OBJECT") & F.col("_claims").isNull(), F.array("_v")).otherwise(F.array().cast("array<variant>"))
    get = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    claim = lambda v: F.struct(*(get(v, f).alias(f) for f in required))

    def good(c: Column) -> Column:
        out = F.coalesce(c["claim_type"].isin(*CLAIM_TYPES), F.lit(False))
        for f in required:
            out = out & ~blank(c[f])
        return out

    rows = rows.withColumn("_items", items).withColumn("claims", F.filter(F.transform("_items", claim), good))
    n, total = F.size("claims"), F.size("_items")
    unread = F.col("_v").isNull() | ~(is_list | F.col("_kind").startswith("OBJECT")) | (F.col("_claims").isNotNull() & ~is_list & ~has_list)
    nothing = blank(raw)
    status = F.when(nothing, "empty").when(unread, "invalid_json").when(n > 0, "ok").when(total == 0, "empty").otherwise("invalid_schema")
    errors = F.when(nothing | unread | (total == 0), 1).otherwise(total - n)
    return rows.select(*df.columns, status.alias("status"), "claims", n.alias("n_claims"), errors.alias("n_errors"))
