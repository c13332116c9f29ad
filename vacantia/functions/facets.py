"""Facet computers: each turns extracted facets into a 1–5 dimension score or null.

A computer takes ``facet`` (a function name → Column) and the preferences and returns a
Column. Null means unknown: the dimension is skipped and its weight goes to the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Facet = Callable[[str], Column]

# Seniority ladder and default score tables.
LADDER = ("junior", "mid", "mid-senior", "senior", "staff", "principal")
YEARS_TO_RUNG = ((8, "staff"), (5, "senior"), (3, "mid-senior"))
AUTONOMY = {"high": 5.0, "medium": 3.0, "low": 1.0}
CULTURE = {"sustainable": 5.0, "balanced": 3.0, "hustle": 1.0}
STAGE = {"public": 5.0, "profitable": 5.0, "late_stage": 4.0, "growth": 4.0, "startup": 2.5, "seed": 1.5, "early": 1.5}
USD_RATE = 1.35


def clamp(c: Column) -> Column:
    """Into 1..5, keeping null (least and greatest skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), c.cast("double"))))


def tier_score(value: Column, tiers: list[dict]) -> Column:
    """Score of the highest tier whose ``min`` the value reaches; below all of them 1."""
    rules = F.when(value.isNull() | (value == 0), F.lit(None).cast("double"))
    for tier in sorted(tiers, key=lambda t: -t["min"]):
        rules = rules.when(value >= float(tier["min"]), float(min(5, max(1, tier["score"]))))
    return rules.otherwise(1.0)


def comp(facet: Facet, prefs: dict) -> Column:
    pay = facet("comp")
    value = F.coalesce(pay["max"], pay["min"]).cast("double")
    in_usd = F.coalesce(pay["currency"].rlike(r"(?i)usd|us\$|\$us"), F.lit(False))
    local = F.when(in_usd, value * float(prefs.get("usd_to_cad") or USD_RATE)).otherwise(value)
    return tier_score(local, prefs.get("comp_tiers") or [])


def _lower_list(words) -> list[str]:
    return [str(w).lower() for w in words or []]


def stack_score(items: Column, group: dict, prefs: dict) -> Column:
    """Preference score of a list of items: avoided, loved, acceptable, unlisted (penalised)."""
    lowered = F.transform(items, lambda x: F.lower(x))
    love, ok, avoid, neutral = (_lower_list(group.get(k)) for k in ("love", "ok", "avoid", "neutral"))

    def holds(words: list[str]) -> Column:
        return F.exists(lowered, lambda x: x.isin(*words)) if words else F.lit(False)

    listed = love + ok + avoid + neutral
    unlisted = F.size(F.filter(lowered, lambda x: ~x.isin(*listed))) if listed else F.size(lowered)
    per_item, most = float(prefs.get("mismatch_penalty", 0.3)), float(prefs.get("max_mismatch_penalty", 1.5))
    bonus = F.when(holds(love), 1.5).when(holds(ok), 0.5).otherwise(0.0)
    penalty = F.least(unlisted * F.lit(per_item), F.lit(most))
    return (
        F.when(items.isNull() | (F.size(items) == 0), F.lit(None).cast("double"))
        .when(holds(avoid), 1.5)
        .otherwise(clamp(F.lit(3.0) + bonus - penalty))
    )


def languages(facet: Facet, prefs: dict) -> Column:
    return stack_score(facet("languages"), prefs.get("languages") or {}, prefs)


def technologies(facet: Facet, prefs: dict) -> Column:
    return stack_score(facet("technologies"), prefs.get("technologies") or {}, prefs)


def tech_stack(facet: Facet, prefs: dict) -> Column:
    first, second = prefs.get("languages") or {}, prefs.get("technologies") or {}
    merged = {k: [*(first.get(k) or []), *(second.get(k) or [])] for k in ("love", "ok", "avoid", "neutral")}
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(facet("languages"), empty), F.coalesce(facet("technologies"), empty))
    return stack_score(both, merged, prefs)


def table_score(value: Column, table: dict[str, float]) -> Column:
    """Score of an enum value; unknown values give null."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.try_element_at(pairs, F.lower(F.coalesce(value, F.lit(""))))


def scope(facet: Facet, prefs: dict) -> Column:
    return clamp(table_score(facet("autonomy"), prefs.get("autonomy_scores") or AUTONOMY))


def wlb(facet: Facet, prefs: dict) -> Column:
    base = table_score(facet("culture"), prefs.get("culture_scores") or CULTURE)
    on_call = F.when(F.coalesce(facet("on_call"), F.lit(False)), 1.0).otherwise(0.0)
    return clamp(base - on_call)


def stability(facet: Facet, prefs: dict) -> Column:
    return clamp(table_score(facet("company_stage"), prefs.get("company_stage_scores") or STAGE))


def ladder_score(seniority: Column, years: Column, desired: str, ladder=LADDER) -> Column:
    """5 minus the distance to the desired rung; managers 1; unknown rungs come from years."""
    desired = desired.lower()
    if desired not in ladder:
        return F.lit(None).cast("double")
    name = F.lower(F.coalesce(seniority, F.lit("")))
    rung = F.nullif(F.array_position(F.array(*[F.lit(r) for r in ladder]), name), F.lit(0).cast("bigint"))
    if ladder == LADDER:
        by_years = F
        for floor, label in YEARS_TO_RUNG:
            by_years = by_years.when(years >= floor, ladder.index(label) + 1)
        rung_or_guess = F.coalesce(rung, by_years.when(years.isNotNull(), ladder.index("mid") + 1))
    else:
        # Years say nothing about a ladder of the user's own.
        rung_or_guess = rung
    distance = F.abs(rung_or_guess - (ladder.index(desired) + 1))
    return F.when(rung.isNull() & (name == "manager"), 1.0).otherwise(clamp(5 - distance))


def level(facet: Facet, prefs: dict) -> Column:
    return ladder_score(facet("seniority"), facet("yoe_min"), prefs.get("desired_level") or "senior")


def remote_tz(facet: Facet, prefs: dict) -> Column:
    geo, policy = F.lower(F.coalesce(facet("geo_eligibility"), F.lit(""))), F.lower(F.coalesce(facet("remote_policy"), F.lit("")))
    hints = F.coalesce(facet("location_hints"), F.array().cast("array<string>"))
    places = F.transform(F.concat(hints, F.array(F.coalesce(facet("timezone"), F.lit("")))), lambda x: F.lower(x))
    wanted = _lower_list(prefs.get("timezone_ok"))
    near = F.exists(places, lambda p: reduce(lambda a, b: a | b, [p.contains(w) for w in wanted])) if wanted else F.lit(False)
    return (
        F.when(geo.isin("us_only", "eu_only"), 1.0)
        .when(policy == "onsite", 1.0)
        .when(policy == "hybrid", 3.0)
        .when((policy == "remote") & (geo.isin("canada", "global") | near), 5.0)
        .when(policy == "remote", 4.0)
    )


def company_fit(facet: Facet, prefs: dict) -> Column:
    """The vetted company's fit, joined in at scoring time; never stored with the facets."""
    return clamp(facet("company_fit"))


COMPUTERS: dict[str, Callable[[Facet, dict], Column]] = {
    "comp": comp, "languages": languages, "technologies": technologies, "tech_stack": tech_stack,
    "scope": scope, "wlb": wlb, "stability": stability, "level": level, "remote_tz": remote_tz,
    "company_fit": company_fit,
}


def register(name: str, computer: Callable[[Facet, dict], Column]) -> None:
    """Add a computer of your own, usable as ``compute: name`` in a rubric."""
    COMPUTERS[name] = computer


# ── relevance before any research ────────────────────────────────────

_SENIOR = r"(?i)\b(senior|staff|principal|lead|sr\.?)\b"


def listing_relevance(title: Column, posted: Column, today: Column, company_fit: Column) -> Column:
    """1, plus 0.5 for a senior title, up to 0.5 for recency and up to 0.5 for the company."""
    days = F.datediff(today, posted)
    senior = F.when(F.coalesce(title, F.lit("")).rlike(_SENIOR), 0.5).otherwise(0.0)
    recent = F.when(days <= 14, 0.5).when(days <= 45, 0.25).otherwise(0.0)
    fit = F.when(company_fit >= 4, 0.5).when(company_fit >= 3, 0.25).otherwise(0.0)
    return F.lit(1.0) + senior + recent + fit


def company_relevance(remote: Column, relevant: Column, titles: Column) -> Column:
    """Remote openings dominate; senior titles and other openings break ties."""
    senior = F.coalesce(F.exists(titles, lambda t: t.rlike("(?i)senior|staff|principal|lead")), F.lit(False))
    return F.coalesce(remote, F.lit(0)) + F.lit(0.5) * senior.cast("int") + F.lit(0.01) * relevant


def display_score(manual: Column, computed: Column, rank: Column) -> Column:
    return F.coalesce(manual.cast("double"), computed.cast("double"), rank.cast("double"))
