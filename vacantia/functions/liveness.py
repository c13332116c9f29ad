"""Is a listing page still open?  Ordered rules over a landed page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# Wording of closed listings, of result lists and of apply controls.
CLOSED_PATTERNS = (
    r"job (is )?no longer available",
    r"job.*no longer open",
    r"position has been filled",
    r"this job has expired",
    r"job posting has expired",
    r"no longer accepting applications",
    r"this (position|role|job) (is )?no longer",
    r"this job (listing )?is closed",
    r"job (listing )?not found",
    r"the page you are looking for doesn.t exist",
    r"applications?\s+(?:(?:have|are|is)\s+)?closed",
    r"closed on \d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"closed on (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}",
    r"diese stelle (ist )?(nicht mehr|bereits) besetzt",
    r"offre (expirée|n'est plus disponible)",
)
# Each closed pattern holds one of these words, which are cheap to look for.
CLOSED_ANCHORS = ("no longer", "filled", "expired", "closed", "not found", "exist", "besetzt", "offre ")
LIST_PATTERNS = (r"\d+\s+jobs?\s+found", r"search for jobs page is loaded")
ERROR_URL = r"[?&]error=true"
APPLY_PATTERNS = (
    r"\bapply\b", r"\bsolicitar\b", r"\bbewerben\b", r"\bpostuler\b",
    r"submit application", r"easy apply", r"start application", r"ich bewerbe mich",
)
MIN_BODY = 300


def _either(patterns) -> str:
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def _has_anchor(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(lambda a, b: a | b, [t.contains(a) for a in CLOSED_ANCHORS]))


def _first_pattern(text: Column, patterns) -> Column:
    return F.coalesce(*[F.when(text.rlike(f"(?iu){p}"), F.lit(p)) for p in patterns])


def liveness(http_status: Column, final_url: Column, body: Column, controls: Column) -> Column:
    """struct(result, code, reason); the first rule that applies decides.

    ``controls`` is the array of captions of the controls visible on the page.
    """
    url, text = F.coalesce(final_url, F.lit("")), F.coalesce(body, F.lit(""))
    can_apply = F.coalesce(F.exists(controls, lambda c: c.rlike(_either(APPLY_PATTERNS))), F.lit(False))

    def verdict(result: str, code: str, reason: Column) -> Column:
        return F.struct(F.lit(result).alias("result"), F.lit(code).alias("code"), reason.alias("reason"))

    return (
        F.when(http_status.isin(404, 410), verdict("expired", "http_gone", F.concat(F.lit("HTTP "), http_status.cast("string"))))
        .when(url.rlike(f"(?i){ERROR_URL}"), verdict("expired", "expired_url", F.concat(F.lit("redirect to "), url)))
        .when(_has_anchor(text) & text.rlike(_either(CLOSED_PATTERNS)),
              verdict("expired", "expired_body", F.concat(F.lit("pattern matched: "), _first_pattern(text, CLOSED_PATTERNS))))
        .when(can_apply, verdict("active", "apply_control_visible", F.lit("visible apply control detected")))
        .when(text.rlike(_either(LIST_PATTERNS)),
              verdict("expired", "listing_page", F.concat(F.lit("pattern matched: "), _first_pattern(text, LIST_PATTERNS))))
        .when(F.length(strip(text)) < MIN_BODY,
              verdict("expired", "insufficient_content", F.lit("insufficient content — likely nav/footer only")))
        .otherwise(verdict("uncertain", "no_apply_control", F.lit("content present but no visible apply control found")))
    )


def history_status(result: Column, code: Column) -> Column:
    """Status written to the scan history for a checked listing."""
    return (
        F.when(result == "expired", "skipped_expired")
        .when(code == "blocked_host", "skipped_blocked_host")
        .when(code.isin("invalid_url", "unsupported_protocol"), "skipped_invalid_url")
        .when((result == "uncertain") & (code == "no_apply_control"), "skipped_no_apply_control")
        .otherwise("added")
    )


def route(result: Column, code: Column) -> Column:
    """Which of the four outputs a checked listing belongs to."""
    return (
        F.when(result == "expired", "expired")
        .when((result == "uncertain") & code.isin("invalid_url", "unsupported_protocol", "blocked_host"), "invalid")
        .when((result == "uncertain") & (code == "no_apply_control"), "dropped")
        .otherwise("verified")
    )
