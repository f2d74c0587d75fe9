"""Queries of the general training-data problems (2, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import history, orphans, snapdiff
from claimloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions begun by a revision."""
    return history.claim_versions(table(spark, sf_dir, "claim_revisions")).where("valid_from_us IS NOT NULL").select("claim_id", "valid_from_us")


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every revised claim with its period and its four values."""
    return history.claim_history(table(spark, sf_dir, "claim_revisions"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {n for r in orphans.REFERENCES for n in (r.table, r.parent)}
    return orphans.orphans({n: table(spark, sf_dir, n) for n in sorted(names)}, table(spark, sf_dir, "deletion_log"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a live parent."""
    return _orphans(spark, sf_dir).select("table_name", "field_name", "record_id").distinct()


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead references counted per table, field and month of receipt."""
    return orphans.orphans_by_month(_orphans(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims added, removed or changed between consecutive snapshots."""
    return snapdiff.snapshot_changes(table(spark, sf_dir, "claim_snapshots"))


def p4_changes_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of :func:`p4_found` per snapshot and kind."""
    return p4_found(spark, sf_dir).groupBy("snapshot_id", "change_type").agg(F.count("*").alias("n_claims"))


QUERIES = {f.__name__: f for f in (p2_found, p2_history, p3_found, p3_orphans_by_month, p4_found, p4_changes_by_snapshot)}

_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _key(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')), '')"


def _refs() -> str:
    return " UNION ALL ".join(
        f"SELECT '{r.table}' AS table_name, '{r.field}' AS field_name, {r.record_id} AS record_id, '{r.parent}' AS parent, {_key(r.field)} AS k, received_at FROM {r.table} WHERE {_key(r.field)} IS NOT NULL" for r in orphans.REFERENCES
    )


def _live() -> str:
    parents = dict.fromkeys((r.parent, r.parent_key) for r in orphans.REFERENCES)
    got = " UNION ALL ".join(f"SELECT '{p}' AS parent, {_key(c)} AS k, received_at FROM {p}" for p, c in parents)
    return f"""SELECT parent, k FROM ({got}) g LEFT JOIN (SELECT record_table AS parent, {_key("record_id")} AS k, max(deleted_at) AS gone FROM deletion_log GROUP BY 1, 2) d USING (parent, k)
    WHERE k IS NOT NULL AND (gone IS NULL OR received_at > gone) GROUP BY parent, k"""


_ORPHANS = f"WITH refs AS ({_refs()}), live AS ({_live()}), o AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.parent = r.parent AND l.k = r.k)) "
_CHANGES = f"""WITH s AS (SELECT snapshot_id, dense_rank() OVER (ORDER BY taken_at, snapshot_id) AS i FROM (SELECT snapshot_id, min(taken_at) AS taken_at FROM claim_snapshots GROUP BY 1)),
r AS (SELECT snapshot_id, claim_id, source_id, claim_type, author_hedging, lower(regexp_replace(record_review_status, '^{_WS}+|{_WS}+$', '', 'g')) AS rs, lower(regexp_replace(quote_match_status, '^{_WS}+|{_WS}+$', '', 'g')) AS qs,
  row_number() OVER (PARTITION BY snapshot_id, claim_id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST) AS n FROM claim_snapshots),
h AS (SELECT i, claim_id, source_id, claim_type, author_hedging, rs, qs FROM r JOIN s USING (snapshot_id) WHERE n = 1),
c AS (SELECT coalesce(b.i, a.i + 1) AS i, coalesce(b.claim_id, a.claim_id) AS claim_id,
  CASE WHEN a.claim_id IS NULL THEN 'added' WHEN b.claim_id IS NULL THEN 'removed'
  WHEN (a.source_id, a.claim_type, a.author_hedging, a.rs, a.qs) IS DISTINCT FROM (b.source_id, b.claim_type, b.author_hedging, b.rs, b.qs) THEN 'changed' END AS change_type
  FROM h a FULL JOIN h b ON a.claim_id = b.claim_id AND b.i = a.i + 1),
f AS (SELECT s.snapshot_id, c.claim_id, c.change_type FROM c JOIN s USING (i) WHERE change_type IS NOT NULL AND i > 1) """
_FIELDS = ", ".join(f"json_extract_string(x, '$.{f}')" for f in history.FIELDS)
_VERSIONS = f"""WITH e AS (SELECT DISTINCT revision_id, claim_id, epoch_us(CAST(created_at AS TIMESTAMPTZ)) AS us,
  (SELECT [{_FIELDS}] FROM (SELECT CAST(previous_content_json AS JSON) AS x)) AS p, (SELECT [{_FIELDS}] FROM (SELECT CAST(new_content_json AS JSON) AS x)) AS n FROM claim_revisions),
v AS (SELECT claim_id, us, p AS k, -1 AS d FROM e UNION ALL SELECT claim_id, us, n, 1 FROM e),
g AS (SELECT claim_id, us, k, sum(d) AS d FROM v GROUP BY ALL),
t AS (SELECT claim_id, us, arg_min(k, d) AS before, arg_max(k, d) AS after FROM g GROUP BY ALL HAVING max(d) > 0 OR count(*) = 1),
w AS (SELECT claim_id, us, after, coalesce(lag(after) OVER (PARTITION BY claim_id ORDER BY us), before) AS was FROM t) """

SQL = {
    "p2_found": _VERSIONS + "SELECT claim_id, us AS valid_from_us FROM w WHERE after IS DISTINCT FROM was",
    "p2_history": _VERSIONS + """, b AS (SELECT claim_id, arg_min(before, us) AS k FROM t GROUP BY 1),
        x AS (SELECT claim_id, us, after AS k FROM w WHERE after IS DISTINCT FROM was UNION ALL SELECT claim_id, NULL, k FROM b)
        SELECT claim_id, us AS valid_from_us, lead(us) OVER (PARTITION BY claim_id ORDER BY us NULLS FIRST) AS valid_to_us, """ + ", ".join(f"k[{i + 1}] AS {f}" for i, f in enumerate(history.FIELDS)) + " FROM x",
    "p3_found": _ORPHANS + "SELECT DISTINCT table_name, field_name, record_id FROM o",
    "p3_orphans_by_month": _ORPHANS + ", m AS (SELECT table_name, field_name, record_id, k, min(received_at) AS first_at FROM o GROUP BY ALL) SELECT table_name, field_name, strftime(first_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(DISTINCT record_id) AS n_records, count(DISTINCT k) AS n_keys FROM m GROUP BY ALL",
    "p4_found": _CHANGES + "SELECT * FROM f",
    "p4_changes_by_snapshot": _CHANGES + "SELECT snapshot_id, change_type, count(*) AS n_claims FROM f GROUP BY ALL",
}
