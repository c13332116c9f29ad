"""Text clean-up expressions. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All white space, as trim() alone removes blanks only.
_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    Catalyst repeats a shared sub-expression inside conditional branches; a costly one (patterns over
    long texts) is bound to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove all white space from both ends; only the ends of a long text are looked at."""
    return F.btrim(c, F.lit(_SPACE))


def lower_strip(c: Column) -> Column:
    return strip(F.lower(c))


def or_else(*cols: Column) -> Column:
    """First value that is neither null nor ''; '' when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def join_present(separator: str, *cols: Column) -> Column:
    """Join the values that are neither null nor ''."""
    return F.concat_ws(separator, *[F.nullif(c, F.lit("")) for c in cols])


def file_safe_key(key: Column) -> Column:
    return F.translate(key, ":/", "--")


def html_to_text(html: Column, escaped: bool = False) -> Column:
    """Readable text from HTML: line breaks, bullets, no tags, six entities decoded.

    With ``escaped=True`` the input is HTML whose markup is itself entity-encoded, so it is
    decoded once before the tags are read. ``&amp;`` is always decoded last, so that
    ``&amp;lt;`` stays the text ``&lt;``.
    """
    text = F.coalesce(html, F.lit(""))
    if escaped:
        text = _decode_entities(text)
    for pattern, replacement in (
        (r"(?i)<\s*br\s*/?>", "\n"),
        (r"(?i)</p>", "\n\n"),
        (r"(?i)</li>", "\n"),
        (r"(?i)<li[^>]*>", "• "),
        (r"<[^>]+>", ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    text = _decode_entities(text)
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(text)


def _decode_entities(c: Column) -> Column:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def decode_ampersands(c: Column) -> Column:
    """Directory names carry the ampersand as ``&#038;`` or ``&amp;``."""
    return strip(F.regexp_replace(c, "&#038;|&amp;", "&"))


def excerpt(body: Column, max_chars: int, skip_lines: int = 2) -> Column:
    """The body without its first lines, trimmed, cut at ``max_chars`` with an ellipsis."""
    rest = strip(F.regexp_replace(F.coalesce(body, F.lit("")), rf"^(?:[^\n]*\n){{0,{skip_lines - 1}}}[^\n]*(?:\n|$)", ""))
    return F.when(F.length(rest) > max_chars, F.concat(F.substring(rest, 1, max_chars), F.lit("…"))).otherwise(rest)


def norm_label(label: Column) -> Column:
    """Lower case, blanks collapsed, trailing ``*`` and ``:`` dropped."""
    text = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"(?U)\s+", " ")
    return strip(F.regexp_replace(text, r"[*:]+\s*$", ""))


def norm_name(name: Column) -> Column:
    """Key for comparing company names: lower case, trimmed."""
    return lower_strip(F.coalesce(name, F.lit("")))


def table_cell(c: Column) -> Column:
    """Text safe inside a Markdown table cell."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s*\|\s*", " / ")
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def clean_missing(c: Column, floating: bool = False) -> Column:
    """Null and NaN become '', everything else trimmed text."""
    missing = c.isNull()
    if floating:
        missing = missing | F.isnan(c)
    return F.when(missing, F.lit("")).otherwise(strip(c.cast("string")))


def name_from_slug(slug: Column) -> Column:
    """``acme_data-labs`` → ``Acme Data Labs`` (only the first letter of a word changes)."""
    words = F.transform(
        F.split(slug, "[-_]"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647)),
    )
    return F.array_join(words, " ")


def title_from_page(page_title: Column, company: Column) -> Column:
    """Listing title from a page title: without company name and board boilerplate."""
    given = strip(page_title)
    literal = F.concat(F.lit(r"(?i)\b\Q"), F.replace(company, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    text = F.when(
        F.coalesce(company, F.lit("")) != "", F.regexp_replace(given, literal, F.lit(""))
    ).otherwise(given)
    text = F.regexp_replace(
        text,
        r"(?i)\b(careers|job application|apply|recruiting|hiring|workday|ashby|greenhouse|lever)\b",
        "",
    )
    text = strip(F.regexp_replace(text, r"^[^a-zA-Z0-9(]+|[^a-zA-Z0-9)]+$", ""))
    return or_else(text, given)


_RESULT_TITLE = r"^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$"


def split_result_title(text: Column) -> Column:
    """Search-result heading → struct(title, company); both null when there is no separator."""
    hit = text.rlike(_RESULT_TITLE)
    part = lambda i: F.when(hit, F.regexp_extract(text, _RESULT_TITLE, i))
    return F.struct(part(1).alias("title"), part(2).alias("company"))


def money_label(low: Column, high: Column, currency: Column) -> Column:
    """``$120k–$150k CAD``; '' when neither bound is known."""
    # Math.round rounds halves up, towards +infinity.
    amount = lambda c: F.concat(F.lit("$"), F.floor(c / 1000 + 0.5).cast("string"), F.lit("k"))
    span = F.concat_ws("–", amount(low), amount(high))
    suffix = F.when(F.coalesce(currency, F.lit("")) != "", F.concat(F.lit(" "), currency)).otherwise("")
    return F.when(span != "", F.concat(span, suffix)).otherwise("")


def plain_punctuation(c: Column) -> Column:
    """Typographic punctuation → ASCII, zero-width space removed, no-break space → blank."""
    text = F.translate(c, "—–“”‘’ ​", "--\"\"'' ")
    return F.replace(text, F.lit("…"), F.lit("..."))


def report_file(cell: Column) -> Column:
    """File name of the first ``….md`` in a link cell, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), r"([\w.\-]+\.md)", 1), F.lit(""))


def relative_report_link(cell: Column, to_root: str) -> Column:
    """Rewrite report links so that they start at the tracker's folder.

    ``to_root`` is the way from that folder to the root of the tree ('' or '../').
    Running it twice changes nothing; other links stay as they are.
    """
    return F.regexp_replace(cell, r"\]\((?:\.\./)*(reports/[^)]+)\)", f"]({to_root}$1)")


def score_class(score: Column) -> Column:
    """Three-way display class of a score."""
    return F.when(score >= 4, "high").when(score >= 3, "mid").otherwise("low")


def labelled_line(text: Column, label: str) -> Column:
    """Text after ``Label:`` at the start of a line, null when the label is absent."""
    pattern = rf"(?m)^\Q{label}\E:[ \t]*(.*)$"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def contact_parts(text: Column) -> Column:
    """``Name <mail>, +1 555…`` → struct(name, email, phone)."""
    def parts(source: Column) -> Column:
        # Most texts hold no address, which a substring test finds out faster than the pattern.
        email = F.when(source.contains("@"), F.regexp_extract(source, r"[\w.+-]+@[\w.-]+\.\w+", 0)).otherwise("")
        phone = strip(F.regexp_extract(source, r"\+?[\d][\d\s().-]{6,}", 0))
        return F.struct(source.alias("source"), email.alias("email"), phone.alias("phone"))

    def named(p: Column) -> Column:
        bare = F.when(p["source"].contains("<"), F.regexp_replace(p["source"], "<[^>]*>", "")).otherwise(p["source"])
        rest = _remove_first(_remove_first(bare, p["email"]), p["phone"])
        name = strip(F.regexp_replace(rest, "[,;]", " "))
        return F.struct(name.alias("name"), p["email"].alias("email"), p["phone"].alias("phone"))

    return let(let(F.coalesce(text, F.lit("")), parts), named)


def _remove_first(text: Column, piece: Column) -> Column:
    """Drop the first occurrence of ``piece``; nothing when it is '' or absent."""
    def without(t: Column) -> Column:
        at = F.instr(t, piece)
        rest = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(piece), F.length(t)))
        return F.when((piece != "") & (at > 0), rest).otherwise(t)

    return let(text, without)
