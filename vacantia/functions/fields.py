"""Kind of an application-form field, from its label and type."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, norm_label, strip

# Label keywords per profile key; earlier entries win.
PROFILE_LABELS = (
    ("first_name", (), ("first name", "given name", "forename")),
    ("last_name", (), ("last name", "surname", "family name")),
    ("full_name", ("name", "your name"), ("full name", "legal name", "candidate name")),
    ("email", (), ("email", "e-mail")),
    ("phone", (), ("phone", "mobile", "telephone", "cell number", "cell phone")),
    ("linkedin", (), ("linkedin",)),
    ("github", (), ("github",)),
    ("portfolio", (), ("portfolio",)),
    ("website", (), ("website", "personal site", "personal website", "blog")),
    ("location", (), ("location", "where are you based", "current location", "street address", "mailing address", "city")),
    ("work_authorization", (), ("authorized to work", "work authorization", "legally authorized", "right to work", "eligible to work", "authorization to work")),
    ("requires_sponsorship", (), ("require sponsorship", "visa sponsorship", "need sponsorship", "sponsorship")),
    ("willing_to_relocate", (), ("relocate", "relocation")),
    ("years_experience", (), ("years of experience", "years experience", "total experience", "how many years")),
    ("current_company", (), ("current company", "current employer", "present employer", "most recent employer")),
    ("current_title", (), ("current title", "current role", "job title", "present title", "current position")),
    ("how_did_you_hear", (), ("how did you hear", "referral source", "how were you referred", "where did you hear")),
)
# The keys of a profile.
PROFILE_KEYS = (
    "first_name", "last_name", "full_name", "email", "phone", "linkedin", "github", "portfolio", "website",
    "location", "city", "work_authorization", "requires_sponsorship", "willing_to_relocate",
    "years_experience", "current_company", "current_title", "how_did_you_hear",
)
# Words of labels that ask for pay, for personal data, for prose, and for a file.
SALARY = ("salary", "compensation expectation", "compensation requirement", "desired pay", "pay expectation", "expected pay", "expected compensation", "desired compensation", "rate expectation", "desired salary", "expected salary")
DEMOGRAPHIC = ("gender", "race", "ethnic", "hispanic", "latino", "veteran", "disab", "sexual orientation", "pronoun", "transgender", "national origin")
FREE_TEXT = ("cover letter", "why do you", "why are you", "why us", "why this", "why would you", "tell us", "in your own words", "what makes you", "additional information", "anything else", "motivat", "open-ended", "short answer", "essay", "describe a", "describe your", "tell me about")
FILE = ("resume", "cv", "cover letter file")
# Fixed value: a longer field asks for prose.
LONG_TEXT = 200


def field_kind(label: Column, kind_of_input: Column, maxlength: Column, mapped_key: Column | None = None) -> Column:
    """struct(kind, profile_key).

    ``mapped_key`` is the profile key the user assigned to this label (from a join), if any.
    """
    control = F.lower(F.coalesce(kind_of_input, F.lit("")))
    mapped_key = F.lit(None).cast("string") if mapped_key is None else mapped_key
    long_text = F.coalesce(maxlength > LONG_TEXT, F.lit(False))

    def result(kind: str, key) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (key if isinstance(key, Column) else F.lit(key).cast("string")).alias("profile_key"))

    def rules(name: Column) -> Column:
        upload_words = F.concat_ws(" ", name, control).rlike("upload|attach|file")
        chain = (
            F.when((control == "file") | ((name != "") & _holds(name, FILE) & upload_words), result("file", "resume"))
            .when(name == "", result("unmapped", None))
            .when(mapped_key.isNotNull(), result("standard", mapped_key))
            .when(_holds(name, SALARY), result("salary", None))
            .when(_holds(name, DEMOGRAPHIC), result("demographic", None))
        )
        for key, exact, keywords in PROFILE_LABELS:
            hit = _holds(name, keywords)
            chain = chain.when(name.isin(*exact) | hit if exact else hit, result("standard", key))
        free_text = (control == "textarea") | _holds(name, FREE_TEXT) | long_text
        return chain.when(free_text, result("free_text", None)).otherwise(result("unmapped", None))

    return let(norm_label(label), rules)


def _holds(name: Column, keywords) -> Column:
    """One alternation per rule keeps the compiled rule chain small."""
    return name.rlike("|".join(re.escape(k) for k in keywords))


def learnable(kind: Column, value: Column) -> Column:
    """Worth remembering: a given answer the profile does not already cover."""
    given = strip(F.coalesce(value, F.lit(""))) != ""
    return given & kind.isin("unmapped", "demographic", "free_text")
