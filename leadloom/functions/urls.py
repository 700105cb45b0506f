"""Column functions over URLs: parts, parameters, portals, canonical forms, board roots.

A URL is split once by the pattern of RFC 3986 (no expression that raises on a broken
URL is used). Hosting portals are data: a :class:`Portal` names its hosts, its tracking
parameters and its paths, so other boards are added without code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import clean_text, key_text
from leadloom.operators.moments import let

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Public suffixes of two labels for the label of a company.
SUFFIXES = ("co.in", "co.jp", "co.uk", "com.au", "com.br", "com.hk", "com.mx", "com.sg")
#: Public suffixes of two labels for registrable domains.
WIDE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.hk", "com.mx", "com.sg", "gov.uk", "net.au", "org.au", "org.uk")
#: Labels before a company's own.
SUBDOMAINS = ("apply", "boards", "careers", "jobs", "www")
#: Hosts that are no company's.
NON_COMPANY_HOSTS = (
    "angel.co", "bit.ly", "crunchbase.com", "discord.com", "docs.google.com", "drive.google.com", "facebook.com", "github.com", "instagram.com", "linkedin.com", "linktr.ee", "medium.com",
    "substack.com", "t.co", "twitter.com", "x.com", "youtube.com",
)
#: Hosts of hosting portals.
PORTAL_HOSTS = ("ashbyhq.com", "boards.greenhouse.io", "greenhouse.io", "job-boards.greenhouse.io", "jobs.ashbyhq.com", "jobs.lever.co", "lever.co")
#: Ends of paths that are files.
FILE_ENDS = (".csv", ".doc", ".docx", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".ppt", ".pptx", ".svg", ".txt", ".webp", ".xls", ".xlsx", ".zip")
#: Sites a search is restricted to, with their portals.
SEARCH_SITES = (
    ("greenhouse", "boards.greenhouse.io"), ("greenhouse", "job-boards.greenhouse.io"), ("lever", "jobs.lever.co"), ("ashby", "jobs.ashbyhq.com"), ("workday", "myworkdayjobs.com"), ("workday", "workday.com"),
)
#: Addresses a slug is tried at.
PROBES = (
    ("greenhouse", "https://boards.greenhouse.io/"), ("greenhouse", "https://job-boards.greenhouse.io/"), ("lever", "https://jobs.lever.co/"), ("ashby", "https://jobs.ashbyhq.com/"),
)


@dataclass(frozen=True)
class Portal:
    """name; host: pattern of its hosts; tracking: parameters to drop; id_param and job_path: a job id given as a parameter moves into the path ``/{slug}/{job_path}{id}``; root: whether the first path segment names a board; job_marker: pattern a path must have; embeds: whether an embedded page names its board by ``for``."""

    name: str
    host: str
    tracking: tuple[str, ...] = ()
    id_param: str | None = None
    job_path: str = ""
    root: bool = True
    job_marker: str | None = None
    trims_apply: bool = False
    embeds: bool = False


#: The known hosting portals.
PORTALS = (
    Portal("greenhouse", r"^(?:boards|job-boards)(?:\.[a-z]{2})?\.greenhouse\.io$", ("gh_src",), "gh_jid", "jobs/", embeds=True),
    Portal("lever", r"^jobs\.lever\.co$", ("lever-source", "lever-via")),
    Portal("ashby", r"^jobs\.ashbyhq\.com$", ("ashby_source",), "jobid", ""),
    Portal("workday", r"(?:^|\.)(?:myworkdayjobs|myworkdaysite|workday)\.com$", ("source", "sourceid", "source_id"), root=False, job_marker=r"/job/", trims_apply=True),
)


def url_parts(url: Column) -> Column:
    """Struct scheme, host, path, query, fragment of the trimmed text; parts that are missing are empty; null gives null."""
    split = F.split(F.regexp_replace(clean_text(url), _SPLIT, "$1\n$2\n$3\n$4\n$5"), "\n", 5)
    return let(split, lambda s: F.when(s.isNotNull(), F.struct(
        F.lower(F.get(s, F.lit(0))).alias("scheme"), F.lower(F.get(s, F.lit(1))).alias("host"), F.get(s, F.lit(2)).alias("path"),
        F.coalesce(F.get(s, F.lit(3)), F.lit("")).alias("query"), F.coalesce(F.get(s, F.lit(4)), F.lit("")).alias("fragment"),
    )))


def is_absolute(p: Column) -> Column:
    return (p["scheme"] != "") & (p["host"] != "")


def join_url(p: Column, path: Column, query: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"], path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def drop_params(query: Column, names: Sequence[str] = (), prefixes: Sequence[str] = ("utm_",)) -> Column:
    """Query text without the named parameters; order and repeated ones stay."""

    def keep(p: Column) -> Column:
        key = F.lower(F.substring_index(p, "=", 1))
        out = ~key.isin(*names) if names else F.lit(True)
        for x in prefixes:
            out = out & ~key.startswith(x)
        return out

    return F.array_join(F.filter(F.split(query, "&"), keep), "&")


def first_param(query: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(query, rf"(?i)(?:^|&){name}=([^&]+)", 1), F.lit(""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def canonical_plain(url: Column) -> Column:
    """Lower-case scheme and host, no slash at the end of a path, no fragment; a text that is no absolute URL stays as it is."""
    trimmed = let(url_parts(url), lambda p: F.when(is_absolute(p), join_url(p, F.when(p["path"] == "/", p["path"]).otherwise(F.regexp_replace(p["path"], "/+$", "")), p["query"])))
    return F.coalesce(trimmed, clean_text(url))


def portal_of(url: Column, portal_type: Column | None = None, portals: Sequence[Portal] = PORTALS) -> Column:
    """Name of the portal: the stated type if it is a known one, else by host; null if none."""
    names = [p.name for p in portals]

    def by_host(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for x in reversed(portals):
            hit = is_absolute(p) & p["host"].rlike(x.host)
            if x.job_marker:
                hit = hit & p["path"].rlike(x.job_marker)
            out = F.when(hit, x.name).otherwise(out)
        return out

    found = let(url_parts(url), by_host)
    if portal_type is None:
        return found
    stated = F.lower(clean_text(portal_type))
    return F.when(stated.isin(*names), stated).otherwise(found)


def canonical_url(url: Column, portal_type: Column | None = None, portals: Sequence[Portal] = PORTALS) -> Column:
    """The company-scoped form of a portal's job URL, else the portal's form without tracking, else :func:`canonical_plain`."""

    def portal_form(x: Portal, p: Column) -> Column:
        path = F.regexp_replace(p["path"], r"(?:/apply)?/*$", "") if x.trims_apply else p["path"]
        kept = drop_params(p["query"], x.tracking)
        if not x.id_param:
            return join_url(p, path, kept)
        first = F.get(segments(p["path"]), F.lit(0))
        in_path = p["path"].rlike(rf"^/+[^/]+/{x.job_path}[^/]+") if x.job_path else F.size(segments(p["path"])) >= 2
        job = first_param(p["query"], x.id_param)
        moved = join_url(p, F.concat(F.lit("/"), first, F.lit(f"/{x.job_path}"), job), F.lit(""))
        return F.when(job.isNotNull() & first.isNotNull() & ~in_path, moved).when(in_path, join_url(p, path, drop_params(p["query"], [*x.tracking, x.id_param]))).otherwise(join_url(p, path, kept))

    def form(name: Column, p: Column) -> Column:
        out = F.lit(None).cast("string")
        for x in portals:
            out = F.when((name == x.name) & is_absolute(p), portal_form(x, p)).otherwise(out)
        return out

    return F.coalesce(let(url_parts(url), lambda p: form(portal_of(url, portal_type, portals), p)), canonical_plain(url))


def board_root(url: Column, portal_type: Column | None = None, portals: Sequence[Portal] = PORTALS) -> Column:
    """``scheme://host/first-segment`` of a portal with boards, or the board an embedded page is ``for``; others null."""

    def root(p: Column) -> Column:
        out = F.lit(None).cast("string")
        embedded = p["path"].rlike(r"^/+embed(?:/|$)")
        for x in portals:
            if x.root:
                board = F.when(embedded, first_param(p["query"], "for")).otherwise(F.get(segments(p["path"]), F.lit(0))) if x.embeds else F.get(segments(p["path"]), F.lit(0))
                out = F.when(p["host"].rlike(x.host) & board.isNotNull(), join_url(p, F.concat(F.lit("/"), board), F.lit(""))).otherwise(out)
        return F.when(is_absolute(p), out)

    return F.when(portal_of(url, portal_type, portals).isNotNull(), let(url_parts(url), root))


def registrable_domain(host: Column, suffixes: Sequence[str] = WIDE_SUFFIXES) -> Column:
    """Last two labels, three under a listed suffix of two labels; a single label gives null."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(host), r":\d+$", ""), r"\."), lambda x: x != "")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) < 2, F.lit(None)).when(two.isin(*suffixes) & (F.size(labels) > 2), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def domain_label(host: Column, suffixes: Sequence[str] = SUFFIXES, subdomains: Sequence[str] = SUBDOMAINS) -> Column:
    """The company's own label of a host: the one before the public suffix, after the common subdomains."""
    bare = F.regexp_replace(F.lower(host), r":\d+$|\.$", "")
    if subdomains:
        bare = F.regexp_replace(bare, rf"^(?:(?:{'|'.join(subdomains)})\.)+(?=[^.]+\.[^.]+)", "")
    labels = F.split(bare, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    at = F.when(two.isin(*suffixes) & (F.size(labels) > 2), F.size(labels) - 3).otherwise(F.size(labels) - 2)
    return F.when(F.size(labels) >= 2, F.get(labels, at))


def company_domain(text: Column) -> Column:
    """Registrable domain of a domain or URL as people write it; addresses of numbers and words without a dot give null."""
    bare = F.lower(F.regexp_replace(clean_text(text), r"^[A-Za-z][A-Za-z0-9+.\-]*://|[/?#].*$|:\d+.*$", ""))
    return F.when(bare.contains(".") & ~bare.rlike(r"^\d+(?:\.\d+){3}$") & ~bare.contains("@"), registrable_domain(F.regexp_replace(bare, r"^www\.(?=[^.]+\.)", "")))


def identity_key(url: Column, canonical: Column, portal_type: Column, job_id: Column, company: Column, title: Column, location: Column, source: Column) -> Column:
    """Key of a job: its id at the portal, host or source; else portal, host or source with company, title and location; missing parts are named."""

    def part(c: Column, name: str) -> Column:
        return F.coalesce(key_text(c), F.lit(f"<missing-{name}>"))

    host = F.nullif(url_parts(F.coalesce(canonical, url))["host"], F.lit(""))
    anchor = F.coalesce(F.lower(clean_text(portal_type)), host, part(source, "source"))
    by_text = F.concat_ws("|", anchor, part(company, "company"), part(title, "title"), part(location, "location"))
    return F.when(key_text(job_id).isNotNull(), F.concat_ws("|", anchor, F.lit("job_id"), key_text(job_id))).otherwise(by_text)


def registry_url(url: Column, portal_type: Column | None = None, portals: Sequence[Portal] = PORTALS) -> Column:
    """Struct url (the board root, else the portal's form, else the URL without fragment) and problem (why a URL can't be registered, or null)."""
    problem = source_problem(url)
    plain = F.regexp_replace(clean_text(url), "#.*$", "")
    form = F.when(portal_of(url, portal_type, portals).isNotNull(), canonical_url(url, portal_type, portals)).otherwise(plain)
    return F.struct(F.when(problem.isNull(), F.coalesce(board_root(url, portal_type, portals), form)).alias("url"), problem.alias("problem"))


def excluded_link(url: Column, seed_domain: Column, hosts: Sequence[str] = (*PORTAL_HOSTS, *NON_COMPANY_HOSTS)) -> Column:
    """Whether a link names no other company: no domain, the page's own one, a portal, a network of people, or a file."""
    p = url_parts(url)
    host = F.regexp_replace(F.regexp_replace(p["host"], r":\d+$", ""), r"^www\.", "")
    domain = company_domain(host)
    file = F.lit(False)
    for end in FILE_ENDS:
        file = file | F.lower(p["path"]).endswith(end)
    return domain.isNull() | F.coalesce(domain == seed_domain, F.lit(False)) | host.isin(*hosts) | domain.isin(*hosts) | file


def search_plans(query: Column, endpoint: str, sites: Sequence[tuple[str, str]] = SEARCH_SITES) -> Column:
    """A search per site: portal, site, search_text, search_url; a blank query gives none."""

    def plan(portal: str, site: str) -> Column:
        text = F.concat(F.trim(query), F.lit(f" site:{site}"))
        return F.struct(F.lit(portal).alias("portal"), F.lit(site).alias("site"), text.alias("search_text"), F.concat(F.lit(endpoint + "?q="), F.url_encode(text)).alias("search_url"))

    return F.when(F.trim(query) != "", F.array(*[plan(*x) for x in sites]))


def probe_urls(slugs: Column, probes: Sequence[tuple[str, str]] = PROBES) -> Column:
    """Addresses to try: each slug at each portal, in order, each address once: portal, slug, url."""
    each = F.transform(F.filter(F.transform(slugs, lambda x: F.lower(F.trim(x))), lambda x: x != ""), lambda x: F.array(*[F.struct(F.lit(n).alias("portal"), x.alias("slug"), F.concat(F.lit(u), x).alias("url")) for n, u in probes]))
    return F.array_distinct(F.flatten(each))


def tenant_hints(url: Column, tenant_hosts: str = r"\.(?:myworkdayjobs|myworkdaysite)\.com$") -> Column:
    """Struct tenant, site, requisition of a URL of a portal whose tenants have hosts of their own; a locale segment is passed over."""

    def hints(p: Column, path: Column) -> Column:
        at_job, at_recruiting = F.array_position(path, "job"), F.array_position(path, "recruiting")
        last = F.element_at(path, -1)
        return F.struct(
            F.when(p["host"].rlike(tenant_hosts), F.nullif(F.substring_index(p["host"], ".", 1), F.lit(""))).when(at_recruiting > 0, F.get(path, at_recruiting.cast("int"))).alias("tenant"),
            F.when(at_job > 1, F.get(path, (at_job - 2).cast("int"))).when((at_job == 0) & (at_recruiting > 0), F.get(path, (at_recruiting + 1).cast("int"))).alias("site"),
            F.when(F.size(path) > 0, F.nullif(F.when(last.contains("_"), F.substring_index(last, "_", -1)).when(F.lower(last) != "job", last), F.lit(""))).alias("requisition"),
        )

    def spoken(all_: Column) -> Column:
        return F.when(F.get(all_, F.lit(0)).rlike("^..-..$"), F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)

    return let(url_parts(url), lambda p: let(spoken(segments(p["path"])), lambda path: hints(p, path)))


def absolute_href(href: Column, base: Column) -> Column:
    """A link of a page as an absolute URL without fragment; anchors, scripts, mail and phone links give null."""
    h = clean_text(href)
    usable = ~h.rlike(r"(?i)^(?:#|javascript:|mailto:|tel:)")

    def resolve(p: Column) -> Column:
        origin = F.concat(p["scheme"], F.lit("://"), p["host"])
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(F.lit("https:"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, p["path"], h))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), h))
        )

    return F.when(usable, F.regexp_replace(let(url_parts(base), resolve), "#.*$", ""))


def extracted_url(c: Column) -> Column:
    """A URL cut out of text: closing signs and fragment dropped; only http and https."""
    cut = F.regexp_replace(F.regexp_replace(clean_text(c), r"[),.;]+$", ""), "#.*$", "")
    return F.when(cut.rlike(r"(?i)^https?://[^/?#]+"), cut)


def redirect_target(url: Column, names: Sequence[str] = ("uddg", "rut", "u", "url")) -> Column:
    """Decoded target of a redirect link, else the URL itself."""
    query = url_parts(url)["query"]
    found = F.coalesce(*[first_param(query, n) for n in names])
    return F.coalesce(F.try_url_decode(found), url)


def job_id_of(url: Column) -> Column:
    """The id of a job in a URL: an id parameter, else a UUID, else the last number of five or more digits of the path."""
    return let(url_parts(url), lambda p: F.coalesce(
        first_param(p["query"], "gh_jid"), first_param(p["query"], "jobid"),
        F.nullif(F.regexp_extract(F.lower(p["path"]), r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1), F.lit("")),
        F.nullif(F.regexp_extract(p["path"], r"^.*(?<!\d)(\d{5,})", 1), F.lit("")),
    ))


def source_problem(url: Column) -> Column:
    """Reason code of a source URL that can't be read; null if it can."""
    return let(url_parts(url), lambda p: F.when(p.isNull(), "blank_source").when(~p["scheme"].isin("http", "https"), "unsupported_scheme").when(p["host"] == "", "missing_host"))


def machine_readable(url: Column) -> Column:
    """Whether a URL looks like a feed of jobs."""
    p = url_parts(url)
    text = F.lower(F.concat_ws(" ", p["path"], p["query"]))
    return text.rlike(r"sitemap|feed|/api/|\.json|\.xml") & text.rlike("job|career|opening")
