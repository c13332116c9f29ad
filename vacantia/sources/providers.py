"""Normalising landed board payloads into one job schema.

Input: one raw payload per row with ``company`` (name in the company list), ``careers_url`` and
``payload``. Output: one row per job with the columns of :data:`JOB`. A provider states where the jobs are in its payload,
how one of them looks, and the job's columns as expressions on it; :func:`provider` registers one, also from user code.

A payload is parsed once, into a VARIANT; its jobs stay variants until the provider's own fields are read from them. So a
mixed table is one pass whatever the number of providers, and a job with an unexpected value loses that value only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_present, or_else, strip
from ..functions.urls import https_on_host, path, resolve_link, workday_parts

COMP_TYPE = "struct<min:double,max:double,currency:string,equity:boolean>"
JOB = (
    "title string, url string, company string, location string, description string, department string, "
    f"date_posted string, comp {COMP_TYPE}, remote_flag string, employment_type string"
)
_TEXT = ("title", "url", "company", "location", "description", "department", "date_posted")
_COLUMNS = (*_TEXT, "comp", "remote_flag", "employment_type")


@dataclass(frozen=True)
class Provider:
    name: str
    jobs: tuple[str, ...]  # where the list of jobs may be; the first that is one counts
    job: str  # the fields read from a job
    columns: Callable[[Column], dict[str, Column]]  # of a job; ``keep`` says which jobs count
    document: Callable[[Column], Column] | None = None  # the JSON in a payload that is more than that
    texts: Callable[[Column], Column] | None = None  # the jobs of a payload that is no JSON, as texts
    base: Callable[[], Column] | None = None  # what a board's address says about the links of its jobs, read once a payload (column ``base``)
    once_by: str | None = None  # a field that a board repeats over its pages: the first job of each value counts


PROVIDERS: dict[str, Provider] = {}


def provider(name: str, jobs: str | tuple[str, ...], job: str, **more):
    """Register a normaliser; the first one registered under a name stays."""

    def add(columns: Callable[[Column], dict[str, Column]]):
        PROVIDERS.setdefault(name, Provider(name, (jobs,) if isinstance(jobs, str) else jobs, job, columns, **more))
        return columns

    return add


def _job(j: Column, p: Provider) -> Column:
    """struct of the job columns, null for a job that does not count; text columns that are not given are empty."""
    null_text = F.lit(None).cast("string")
    given = p.columns(j)
    keep = given.pop("keep", F.lit(True))
    values = {c: F.lit("") for c in _TEXT} | {
        "company": F.col("company"), "comp": F.lit(None).cast(COMP_TYPE), "remote_flag": null_text, "employment_type": F.lit(""),
    } | given
    made = F.struct(*[(F.coalesce(values[c], F.lit("")) if c in _TEXT or c == "employment_type" else values[c]).alias(c) for c in _COLUMNS])
    return F.when(j.isNotNull() & F.coalesce(keep, F.lit(False)), made)


def _typed(p: Provider) -> Column:
    return F.try_variant_get("__job", "$", p.job)


def _elements(p: Provider) -> Column:
    """The jobs of a payload, each a variant."""
    if p.texts is not None:
        return F.transform(p.texts(F.col("payload")), lambda x: x.cast("variant"))
    return F.coalesce(*[F.try_variant_get("__document", where, "array<variant>") for where in p.jobs])


def _rows(payloads: DataFrame, chosen: list[Provider], name: Column | None) -> DataFrame:
    """One row per job: name, company, careers_url, page, place in the payload, the job as a variant."""
    page = F.col("page") if "page" in payloads.columns else F.lit(0)
    text = F.col("payload")

    def by_name(values: dict[str, Column], otherwise: Column | None = None) -> Column:
        if name is None:
            return next(iter(values.values()), otherwise)
        if not values:
            return otherwise
        out = F
        for n, v in values.items():
            out = out.when(name == n, v)
        return out if otherwise is None else out.otherwise(otherwise)

    documents = {p.name: p.document(text) for p in chosen if p.document is not None}
    bases = {p.name: p.base() for p in chosen if p.base is not None}
    own = [] if name is None else [name.alias("provider")]
    parsed = payloads.select(
        *own, "company", "careers_url", page.alias("page"), "payload", by_name(bases, F.lit(None).cast("string")).alias("base"),
        F.try_parse_json(by_name(documents, text)).alias("__document"),
    )
    kept = [*(["provider"] if own else []), "company", "careers_url", "base", "page"]
    return parsed.select(*kept, F.posexplode(by_name({p.name: _elements(p) for p in chosen})).alias("pos", "__job"))


def normalize(payloads: DataFrame, name: str) -> DataFrame:
    """Jobs of one provider's payloads."""
    p = PROVIDERS[name]
    rows = _rows(payloads, [p], None).select("company", "careers_url", "base", "page", "pos", _typed(p).alias("j"))
    if p.once_by is not None:
        field = F.col(f"j.{p.once_by}")
        rows = rows.where(F.coalesce(field, F.lit("")) != "").groupBy("company", "careers_url", "base", field.alias("__by")).agg(F.min_by("j", F.struct("page", "pos")).alias("j"))
    made = rows.select(_job(F.col("j"), p).alias("job")).where("job IS NOT NULL")
    return made.select("job.*")


def normalize_all(payloads: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Jobs of a mixed payload table (column ``provider``) in one pass: each row by its own provider's rules.

    Providers whose pages overlap need their jobs brought together; only their payloads are read for that, a second time.
    """
    wanted = [PROVIDERS[n] for n in names or list(PROVIDERS)]
    plain, paged = [p for p in wanted if p.once_by is None], [p for p in wanted if p.once_by is not None]
    parts = [normalize(payloads.where(F.col("provider") == p.name), p.name).withColumn("provider", F.lit(p.name)) for p in paged]
    if plain:
        rows = _rows(payloads.where(F.col("provider").isin([p.name for p in plain])), plain, F.col("provider"))
        job = F
        for p in plain:
            job = job.when(F.col("provider") == p.name, _job(_typed(p), p))
        made = rows.select("provider", job.alias("job")).where("job IS NOT NULL")
        parts.insert(0, made.select("job.*", "provider"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _slug(pattern: str) -> Column:
    return F.regexp_extract(F.coalesce("careers_url", F.lit("")), pattern, 1)


def _given(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & (F.coalesce(v, F.lit("")) != "")
    return out


def _texts(array: Column) -> Column:
    return F.filter(array, lambda x: F.coalesce(x, F.lit("")) != "")


@provider(
    "greenhouse", "$.jobs",
    "struct<title:string,absolute_url:string,location:struct<name:string>,content:string,departments:array<struct<name:string>>,"
    "updated_at:string,first_published:string>",
)
def greenhouse(j: Column) -> dict[str, Column]:
    return {
        "title": j["title"], "url": j["absolute_url"], "location": j["location"]["name"], "description": j["content"],
        "department": F.try_element_at(j["departments"], F.lit(1))["name"], "date_posted": or_else(j["updated_at"], j["first_published"]),
        "keep": _given(j["absolute_url"]),
    }


@provider(
    "ashby", "$.jobs",
    "struct<title:string,jobUrl:string,location:string,secondaryLocations:array<struct<location:string>>,descriptionPlain:string,"
    f"descriptionHtml:string,department:string,team:string,publishedAt:string,compensation:{COMP_TYPE},isRemote:boolean,employmentType:string>",
)
def ashby(j: Column) -> dict[str, Column]:
    more = F.coalesce(F.transform(j["secondaryLocations"], lambda x: x["location"]), F.array().cast("array<string>"))
    return {
        "title": j["title"], "url": j["jobUrl"], "location": F.array_join(_texts(F.concat(F.array(j["location"]), more)), ", "),
        "description": or_else(j["descriptionPlain"], j["descriptionHtml"]), "department": or_else(j["department"], j["team"]),
        "date_posted": j["publishedAt"], "comp": j["compensation"], "remote_flag": F.when(j["isRemote"], "remote"), "employment_type": j["employmentType"],
    }


@provider(
    "lever", "$",
    "struct<text:string,hostedUrl:string,workplaceType:string,categories:struct<location:string,allLocations:array<string>,team:string,"
    f"department:string,commitment:string>,descriptionPlain:string,description:string,createdAt:bigint,salaryRange:{COMP_TYPE}>",
)
def lever(j: Column) -> dict[str, Column]:
    kinds = j["categories"]
    everywhere = F.coalesce(kinds["allLocations"], F.array().cast("array<string>"))
    places = F.array_distinct(F.concat(F.array(kinds["location"], j["workplaceType"]), everywhere))
    return {
        "title": j["text"], "url": j["hostedUrl"], "location": F.array_join(_texts(places), ", "),
        "description": or_else(j["descriptionPlain"], j["description"]), "department": or_else(kinds["team"], kinds["department"]),
        "date_posted": F.when(j["createdAt"] != 0, F.date_format(F.timestamp_millis(j["createdAt"]), "yyyy-MM-dd")),
        "comp": j["salaryRange"], "employment_type": kinds["commitment"],
    }


@provider(
    "gem", "$[0].data.oatsExternalJobPostings.jobPostings",
    "struct<extId:string,title:string,descriptionHtml:string,locations:array<struct<name:string>>,job:struct<employmentType:string,department:struct<name:string>>>",
    base=lambda: F.concat(F.lit("https://jobs.gem.com/"), _slug(r"jobs\.gem\.com/([^/?#]+)"), F.lit("/")),
)
def gem(j: Column) -> dict[str, Column]:
    return {
        "title": j["title"], "url": F.concat(F.col("base"), j["extId"]),
        "location": F.array_join(F.transform(j["locations"], lambda x: F.coalesce(x["name"], F.lit(""))), " • "),
        "description": j["descriptionHtml"], "department": j["job"]["department"]["name"], "employment_type": j["job"]["employmentType"],
    }


@provider(
    "bamboohr", "$.result",
    "struct<id:string,jobOpeningName:string,location:struct<city:string,state:string,country:string>,isRemote:string,atsLocation:struct<isRemote:boolean>>",
    base=lambda: F.concat(F.lit("https://"), _slug(r"(?i)^https?://([a-z0-9-]+)\.bamboohr\.com"), F.lit(".bamboohr.com/careers/")),
)
def bamboohr(j: Column) -> dict[str, Column]:
    remote = F.coalesce(j["isRemote"] == "yes", F.lit(False)) | F.coalesce(j["atsLocation"]["isRemote"], F.lit(False))
    place = join_present(", ", *[j["location"][x] for x in ("city", "state", "country")])
    return {
        "title": j["jobOpeningName"], "url": F.concat(F.col("base"), j["id"]),
        "location": F.concat(place, F.when(remote, " Remote").otherwise("")), "keep": _given(j["id"], j["jobOpeningName"]) & (j["id"] != "0"),
    }


@provider(
    "breezy", "$",
    "struct<name:string,friendly_id:string,url:string,location:struct<name:string,city:struct<name:string>,country:struct<name:string>,is_remote:boolean>>",
    base=lambda: F.concat(F.lit("https://"), _slug(r"(?i)^https?://([a-z0-9-]+)\.breezy\.hr"), F.lit(".breezy.hr/p/")),
)
def breezy(j: Column) -> dict[str, Column]:
    at = j["location"]
    place = or_else(at["name"], join_present(", ", at["city"]["name"], at["country"]["name"]))
    return {
        "title": j["name"], "url": or_else(j["url"], F.concat(F.col("base"), j["friendly_id"])),
        "location": F.concat(place, F.when(F.coalesce(at["is_remote"], F.lit(False)), " Remote").otherwise("")), "keep": _given(j["name"], j["friendly_id"]),
    }


def _href(url: Column) -> Column:
    """A web URL as a browser writes it: lower-case scheme and host, a root path for none."""
    text = strip(url)
    rest = F.regexp_extract(text, r"(?i)^https?://[^/?#]+(.*)$", 1)
    start = F.regexp_extract(text, r"(?i)^https?://[^/?#]+", 0)
    return F.concat(F.lower(start), F.when(rest.startswith("/"), "").otherwise("/"), rest)


@provider("recruitee", "$.offers", "struct<title:string,careers_url:string,url:string,city:string,country:string,remote:boolean,location:string>")
def recruitee(j: Column) -> dict[str, Column]:
    link = or_else(j["careers_url"], j["url"])
    trusted = https_on_host(link, r"[a-z0-9][a-z0-9-]*\.recruitee\.com")
    remote = F.when(j["remote"], "Remote").otherwise("")
    return {
        "title": j["title"], "url": F.when(trusted, _href(link)).otherwise(""),
        "location": or_else(j["location"], join_present(", ", j["city"], j["country"], remote)),
    }


def _dashed(text: Column) -> Column:
    slug = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(slug, "^-|-$", "")


@provider(
    "smartrecruiters", "$.content",
    "struct<id:string,name:string,ref:string,location:struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>>",
)
def smartrecruiters(j: Column) -> dict[str, Column]:
    at = j["location"]
    place = or_else(at["fullLocation"], join_present(", ", at["city"], at["region"], at["country"]))
    remote = F.when(at["remote"], "Remote").otherwise("")
    ref = F.coalesce(j["ref"], F.lit(""))
    trusted = https_on_host(ref, r"api\.smartrecruiters\.com") & path(ref).startswith("/v1/companies/")
    public = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.substring(path(ref), len("/v1/companies/") + 1, 2147483647))
    board = _dashed(F.col("company"))
    made = F.when(
        _given(j["id"]) & (board != ""), F.concat(F.lit("https://jobs.smartrecruiters.com/"), board, F.lit("/"), j["id"], F.lit("-"), _dashed(j["name"]))
    )
    return {"title": j["name"], "url": F.coalesce(F.when(trusted, public), made), "location": join_present(", ", place, remote)}


@provider("workable", (), "string", texts=lambda payload: F.filter(F.split(F.coalesce(payload, F.lit("")), "\n"), lambda x: x.startswith("|") & x.contains("[View]")))
def workable(j: Column) -> dict[str, Column]:
    cell = lambda k: strip(F.get(F.split(j, r"\|"), F.lit(k)))
    link = F.regexp_replace(F.regexp_extract(j, r"\[View\]\(([^)]+)\)", 1), r"\.md$", "")
    keep = (F.size(F.split(j, r"\|")) >= 8) & ~cell(1).isin("", "Title") & https_on_host(link, r"apply\.workable\.com")
    return {"title": cell(1), "url": _href(link), "location": cell(3), "keep": keep}


def _workday_base() -> Column:
    info = workday_parts(F.col("careers_url"))
    prefix = F.when(info["locale"] != "", F.concat(F.lit("/"), info["locale"])).otherwise("")
    return F.concat(F.lit("https://"), info["host"], prefix, F.lit("/"), info["site"])


@provider("workday", "$.jobPostings", "struct<title:string,externalPath:string,locationsText:string>", base=_workday_base, once_by="externalPath")
def workday(j: Column) -> dict[str, Column]:
    """Several pages and search terms of a board may list a job; the first of each path counts."""
    link = F.concat(F.col("base"), j["externalPath"])
    return {"title": j["title"], "url": link, "location": j["locationsText"], "keep": _given(j["title"], link)}


def _usable_list(script: Column) -> Column:
    """Of the page's queries the first whose data is a list of linked jobs, as JSON."""
    item = "struct<name:string,url:string,locations:array<struct<city:string,`state`:string,country:string,workplaceType:string>>>"
    queries = F.from_json(script, f"struct<props:struct<pageProps:struct<dehydratedState:struct<queries:array<struct<`state`:struct<data:struct<items:array<{item}>>>>>>>>>")
    lists = F.transform(queries["props"]["pageProps"]["dehydratedState"]["queries"], lambda q: q["state"]["data"]["items"])
    usable = F.filter(lists, lambda x: F.coalesce(F.try_element_at(x, F.lit(1))["url"], F.lit("")) != "")
    return F.to_json(F.try_element_at(usable, F.lit(1)))


@provider(
    "rippling", "$",
    "struct<name:string,url:string,locations:array<struct<city:string,`state`:string,country:string,workplaceType:string>>>",
    base=lambda: F.concat(F.lit("https://ats.rippling.com/"), _slug(r"(?i)ats\.rippling\.com/([^/?#]+)"), F.lit("/jobs")),
    document=lambda payload: _usable_list(F.regexp_extract(payload, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)),
)
def rippling(j: Column) -> dict[str, Column]:
    places = F.transform(
        j["locations"],
        lambda x: F.concat(join_present(", ", x["city"], x["state"], x["country"]), F.when(x["workplaceType"] == "REMOTE", " Remote").otherwise("")),
    )
    return {"title": j["name"], "url": resolve_link(j["url"], F.col("base")), "location": F.array_join(places, "; "), "keep": _given(j["name"], j["url"])}


@provider(
    "local-parser", ("$", "$.jobs", "$.results"),
    "struct<title:string,name:string,url:string,jobUrl:string,job_url:string,applyUrl:string,apply_url:string,company:string,location:string,locations:string>",
)
def local_parser(j: Column) -> dict[str, Column]:
    """Output of a user's own parser: an array, or an object with ``jobs`` or ``results``."""
    link = or_else(*[j[c] for c in ("url", "jobUrl", "job_url", "applyUrl", "apply_url")])
    title, url = strip(or_else(j["title"], j["name"])), resolve_link(link, F.col("careers_url"))
    return {
        "title": title, "url": url, "company": strip(or_else(j["company"], F.col("company"))),
        "location": _flat_location(or_else(j["location"], j["locations"])), "keep": _given(title, url),
    }


def _flat_location(raw: Column) -> Column:
    """A location that may be text, an object with name or text, or a list of either."""
    one = "struct<name:string,text:string>"
    named = lambda x: or_else(x["name"], x["text"])
    texts = F.from_json(raw, "array<string>")
    items = F.transform(
        texts, lambda x: F.when(x.startswith("{"), named(F.from_json(x, one))).otherwise(strip(x))
    )
    joined = F.array_join(F.filter(items, lambda x: x != ""), ", ")
    return F.when(raw.startswith("["), joined).when(raw.startswith("{"), named(F.from_json(raw, one))).otherwise(strip(raw))


# ── public feeds and directories ─────────────────────────────────────

FEED = "company_name string, title string, description string, location string, url string, tags array<string>"


def remote_feed(payloads: DataFrame, array: str = "jobs", location: str = "candidate_required_location") -> DataFrame:
    """A remote-only board: its location column is taken as it is."""
    schema = (
        f"{array} array<struct<company_name:string,title:string,description:string,{location}:string,url:string,tags:array<string>>>"
    )
    j = payloads.select(F.explode(F.from_json("payload", schema)[array]).alias("j"))
    return _feed(j, F.col(f"j.{location}"))


def flagged_feed(payloads: DataFrame, array: str = "data") -> DataFrame:
    """A general board: remote jobs get ``Remote`` added to their location."""
    schema = (
        f"{array} array<struct<company_name:string,title:string,description:string,location:string,remote:boolean,url:string,tags:array<string>>>"
    )
    j = payloads.select(F.explode(F.from_json("payload", schema)[array]).alias("j"))
    place = F.coalesce("j.location", F.lit(""))
    remote = F.when(place != "", F.concat(place, F.lit(" Remote"))).otherwise("Remote")
    return _feed(j, F.when(F.coalesce("j.remote", F.lit(False)), remote).otherwise(F.col("j.location")))


def _feed(rows: DataFrame, location: Column) -> DataFrame:
    return rows.select(
        F.col("j.company_name"), F.col("j.title"), F.coalesce("j.description", F.lit("")).alias("description"),
        location.alias("location"), F.col("j.url"), F.coalesce("j.tags", F.array().cast("array<string>")).alias("tags"),
    )


def cached_feed(jobs: DataFrame) -> DataFrame:
    """Rows of the broad feed cache in the feed shape (no description, no tags)."""
    return jobs.select(
        F.col("company").alias("company_name"), "title", F.lit("").alias("description"), "location", "url",
        F.array().cast("array<string>").alias("tags"),
    )


def directory(payloads: DataFrame) -> DataFrame:
    """A portfolio or accelerator list → (name, url) with entities decoded."""
    from ..functions.text import decode_ampersands

    schema = "array<struct<name:string,title:struct<rendered:string>,link:string,website:string>>"
    j = payloads.select(F.explode(F.from_json("payload", schema)).alias("j"))
    name = decode_ampersands(or_else(F.col("j.title.rendered"), F.col("j.name")))
    return j.select(name.alias("name"), or_else(F.col("j.link"), F.col("j.website")).alias("url")).where("name <> ''")


