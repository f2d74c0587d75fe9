"""Pieces of SQL that several checks share; the twins of ``claimloom.functions.text``."""

from __future__ import annotations

from claimloom.functions.text import DASHES, WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def normalise(x: str) -> str:
    return strip(f"translate({collapse(f'nfc_normalize({x})')}, '{DASHES}', '{'-' * len(DASHES)}')")


def once(table: str, record_id: str) -> str:
    """A delivery log with one row per record."""
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {record_id} ORDER BY received_at) = 1)"


def lane(h: str, start: int) -> str:
    return f"CAST(coalesce(sum(CAST('0x' || substr({h}, {start}, 15) AS BIGINT)), 0) AS VARCHAR)"


def canonical_row(columns: list[str]) -> str:
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(columns)) + ")"
