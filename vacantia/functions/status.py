"""Application statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Canonical statuses, those that occupy a slot, and accepted other spellings.
CANONICAL = ("Evaluated", "Applied", "Responded", "Interview", "Offer", "Rejected", "Discarded", "SKIP")
OPEN = ("Applied", "Responded", "Interview", "Offer")
ALIASES = {
    "evaluada": "Evaluated", "condicional": "Evaluated", "hold": "Evaluated", "evaluar": "Evaluated", "verificar": "Evaluated",
    "aplicado": "Applied", "enviada": "Applied", "aplicada": "Applied", "applied": "Applied", "sent": "Applied", "submitted": "Applied",
    "respondido": "Responded",
    "entrevista": "Interview",
    "oferta": "Offer",
    "rechazado": "Rejected", "rechazada": "Rejected",
    "descartado": "Discarded", "descartada": "Discarded", "cerrada": "Discarded", "cancelada": "Discarded",
    "no aplicar": "SKIP", "no_aplicar": "SKIP", "skip": "SKIP", "monitor": "SKIP", "geo blocker": "SKIP",
}
_SPELLINGS = {**ALIASES, **{name.lower(): name for name in CANONICAL}}


def canonical_status(status: Column) -> Column:
    """Any spelling → canonical status: no asterisks, no trailing date, aliases; else Evaluated."""
    bare = F.replace(F.coalesce(status, F.lit("")), F.lit("**"), F.lit(""))
    key = F.lower(strip(F.regexp_replace(bare, r"(?s)\s+\d{4}-\d{2}-\d{2}.*$", "")))
    table = F.create_map(*[F.lit(x) for pair in _SPELLINGS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(table, key),
        F.when(key.rlike("^(duplicado|dup|repost)"), "Discarded"),
        F.lit("Evaluated"),
    )


def is_open(status: Column) -> Column:
    return F.coalesce(status.isin(*OPEN), F.lit(False))


def stage_chip(status: Column, decision: Column) -> Column:
    """Short label for a row: the application's status wins over the decision."""
    known = F.coalesce(status, F.lit("")) != ""
    return (
        F.when(known & status.rlike("(?i)offer"), "keep")
        .when(known & status.rlike("(?i)reject|discard"), "skip")
        .when(known, "status")
        .when(decision.isin("shortlist", "applied", "skip"), decision)
        .otherwise("none")
    )
