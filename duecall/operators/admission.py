"""Which pages, calls and links are let in: rule chains, link policies, scope, public addresses.

Every chain keeps all failing rules by name; a row is admitted where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecall.functions import dates as D
from duecall.functions import text as T
from duecall.operators.evidence import reasons

# Subject groups, of which a page in scope meets two; phrases of calls; hosts of forms and lead collections.
SCOPE = {
    "computing": r"comput(?:er|ing) science|algorithm|software",
    "data": r"\bdata (?:science|mining|management|analytics)|big data|database",
    "learning": r"machine learning|deep learning|artificial intelligence|neural network",
    "language": r"natural language|language model|text mining",
    "security": r"cyber ?security|privacy|cryptograph",
    "systems": r"distributed system|cloud|internet of things|network",
}
CHAPTERS = r"call for (?:book )?chapters?|chapter proposals?|submit (?:a )?chapter"
BOOKS = r"(?:book|monograph) proposals?|propos(?:e|ing) a book|publish (?:a|your) book"
RED_FLAGS = r"guaranteed (?:publication|acceptance)|(?:fast|rapid) publication within|pay(?:ment)? for acceptance"
PEER_REVIEW = r"peer[- ]review|refereed|reviewed by (?:at least )?(?:two|three)"
RECRUITS = r"call for reviewers|(?:volunteer|apply|sign[ -]?up|register) (?:as|to be|to become) (?:a )?(?:reviewer|program committee member)|reviewer (?:application|registration|sign-up|interest form)"
RECRUITS_NO_MORE = r"(?:reviewer )?(?:applications?|registration|recruitment) (?:is|are|has|have)(?: now| been)? closed|no longer (?:accepting|recruiting) reviewers"
FORM_HOSTS = ["docs.google.com", "forms.gle", "forms.office.com", "surveymonkey.com", "openreview.net"]
LEADS_HOST = "wikicfp.com"
SOURCES = [("wikicfp", r"wikicfp\.com"), ("cmt", r"cmt3\.research\.microsoft\.com"), ("easychair", r"easychair\.org"), ("hotcrp", r"hotcrp\.com"), ("openreview", r"openreview\.net"), ("springer", r"springer")]
ORGANIZERS = r"call for (?:workshops?|tutorials?)\b|workshop (?:and tutorial )?proposals?|propose a workshop"


def _has(text: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(pattern)


def scope(text: Column, keywords: list[str]) -> Column:
    """struct(relevant, groups, configured): a configured keyword, or two groups at least; one generic word is no evidence."""
    low = F.lower(F.coalesce(text, F.lit("")))
    groups = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in SCOPE.items())))
    configured = F.array_compact(F.array(*(F.when(low.contains(k.lower()), F.lit(k)) for k in keywords))) if keywords else F.array().cast("array<string>")
    return F.struct(((F.size(configured) > 0) | (F.size(groups) >= 2)).alias("relevant"), groups.alias("groups"), configured.alias("configured"))


def book_rules(url: Column, text: Column, domains: list[str], keywords: list[str], reputable: Column, reviewed: Column, now: Column, route_verified: Column, subject_verified: Column) -> tuple[Column, Column, Column]:
    """(call type, deadline, failing rules) of a publisher's page that calls for books or chapters."""
    kind = F.when(_has(text, CHAPTERS), "chapter-proposal").otherwise("book-proposal")
    due = D.labelled_date(text, D.BOOK_LABELS, now)
    rules = {
        "approved-domain": T.allowed(T.host(url), domains),
        "https": F.lower(url).startswith("https:"),
        "reputation": reputable,
        "no-red-flags": ~_has(text, RED_FLAGS),
        "explicit-route": (kind == "chapter-proposal") | _has(text, BOOKS) | F.coalesce(route_verified, F.lit(False)),
        "scope": scope(text, keywords)["relevant"] | F.coalesce(subject_verified, F.lit(False)),
        "chapter-deadline": (kind != "chapter-proposal") | due.isNotNull(),
        "deadline-ahead": due.isNull() | (due > now),
        "peer-review": _has(text, PEER_REVIEW) | F.coalesce(reviewed, F.lit(False)),
    }
    return kind, due, reasons(rules)


def application(links: Column, configured: Column, domains: list[str]) -> Column:
    """The link to apply by: the configured one if the page has it, else the first reviewer link to an official or form host."""
    own = F.filter(links, lambda x: configured.isNotNull() & x["href"].startswith(configured))
    hosts = [*domains, *FORM_HOSTS]
    fit = F.filter(links, lambda x: _has(F.concat_ws(" ", x["text"], x["href"]), r"reviewer|volunteer|interest form|sign[ -]?up") & T.allowed(T.host(x["href"]), hosts))
    return F.coalesce(F.get(own, F.lit(0))["href"], F.get(fit, F.lit(0))["href"])


def reviewer_rules(url: Column, text: Column, names: Column, route: Column, domains: list[str], ends_at: Column, now: Column) -> Column:
    """The failing rules of a page that recruits reviewers; names is an array of the venue's names, short ones don't count."""
    long = F.filter(names, lambda x: F.length(x) >= 3)
    return reasons(
        {
            "official-domain": T.allowed(T.host(url), domains),
            "recruitment": _has(text, RECRUITS) & ~_has(text, RECRUITS_NO_MORE),
            "venue-identity": (F.size(long) == 0) | F.exists(long, lambda x: F.lower(text).contains(F.lower(x))),
            "application-route": route.isNotNull(),
            "service-window": ends_at.isNull() | (ends_at > now),
        }
    )


def external_rules(kind: Column, deadline: Column, on_page: Column, official_page: Column, url: Column, level: Column, quality: Column, score: Column, proceedings: Column, publisher: Column, parent: Column, identity: Column, now: Column) -> Column:
    """The failing rules of a call that others brought up: a lead, never the page or the verdict itself, may come from a collection."""
    on = lambda c: F.coalesce(c, F.lit(False))
    journal = F.coalesce(kind, F.lit("")).isin("journal", "special-issue")
    return reasons(
        {
            "future-deadline": deadline > now,
            "deadline-on-official-page": on_page,
            "official-page": official_page,
            "not-a-lead-collection": ~on(T.allowed(T.host(url), [LEADS_HOST])),
            "trusted": level == "trusted",
            "corroborated": quality == "corroborated",
            "score": score >= 3,
            "venue-evidence": journal | on(proceedings) | on(publisher) | on(parent),
            "journal-identity": ~journal | on(identity),
        }
    )


def operator_fallback(error: Column, allowed: Column, route: Column, subject: Column, reviewed_at: Column, peer_reviewed: Column, url: Column, series: Column, domains: list[str]) -> Column:
    """Whether reviewed evidence stands in for a page that failed for the moment only: all seven conditions."""
    passing = _has(error, r"http[_ ]?(?:403|429|5[0-9][0-9])|fetch failed|network|timeout")
    on = lambda c: F.coalesce(c, F.lit(False))
    official = T.allowed(T.host(url), domains) & T.allowed(T.host(F.coalesce(series, url)), domains)
    return passing & on(allowed) & on(route) & on(subject) & reviewed_at.isNotNull() & on(peer_reviewed) & official


def organizer_call(text: Column) -> Column:
    """Whether a page calls for workshops rather than for papers."""
    return _has(text, ORGANIZERS)


def primary_url(kind: Column, candidates: list[Column], paths: list[str]) -> Column:
    """The first safe URL; a workshop's is never a page that calls for organizers."""
    path = lambda u: F.lower(F.regexp_replace(u, r"^https?://[^/?#]*", ""))
    organizers = lambda u: F.coalesce(kind == "workshop", F.lit(False)) & F.exists(F.array(*map(F.lit, paths)), lambda p: path(u).contains(p)) if paths else F.lit(False)
    return F.coalesce(*(F.when(~organizers(u), u) for u in map(T.normal_url, candidates)))


def safe_links(links: Column) -> Column:
    """array<struct(label, url)> with normal URLs, without those that aren't safe."""
    return F.filter(F.transform(links, lambda x: F.struct(x["label"].alias("label"), T.normal_url(x["url"]).alias("url"))), lambda x: x["url"].isNotNull())


def public_address(url: Column) -> Column:
    """Whether a URL may be fetched: http(s) without credentials, on a usual port, and no local
    name, private, loopback, link-local, shared, reserved or multicast address."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    octets = F.transform(F.split(name, r"\."), lambda x: x.try_cast("int"))
    a, b, c = (F.get(octets, F.lit(k)) for k in range(3))
    numeric = name.rlike(r"^[0-9.]+$")
    valid = name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(octets, lambda x: x <= 255)
    private = (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)))) | ((a == 100) & b.between(64, 127)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    six = name.startswith("[")
    local = name.rlike(r"(^|\.)localhost$|\.(?:local|internal)$|^metadata\.")
    six_ok = name.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:]+\]$")
    host_ok = F.when(six, six_ok).when(numeric, valid & ~private).otherwise(name.contains(".") & ~local)
    return F.coalesce((authority != "") & ~authority.contains("@") & port.isin("", "80", "443") & host_ok, F.lit(False))


def claimed_edition(text: Column) -> Column:
    """The number of "the 12th international conference", or null."""
    found = F.regexp_extract(F.lower(text), r"\b([0-9]{1,3})(?:st|nd|rd|th) (?:annual )?(?:international )?(?:conference|workshop|symposium|meeting|forum|congress)\b", 1)
    return F.nullif(found, F.lit("")).cast("int")


def years_near(text: Column, identity: Column, before: int = 140, after: int = 180) -> Column:
    """The distinct years of a text that have identity within so many characters before or after their start."""
    low, word = F.lower(text), F.lower(identity)
    pieces = F.split(low, r"(?=\b(?:19|20)[0-9]{2}\b)")
    ends = F.transform(pieces, lambda p, i: F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")))
    starts = F.filter(F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("p"), (e - F.length(p)).alias("at"))), lambda x: x["p"].rlike(r"^(?:19|20)[0-9]{2}\b"))
    around = lambda at: F.substr(low, F.greatest(F.lit(1), at + 1 - before), at + 1 + after - F.greatest(F.lit(1), at + 1 - before))
    near = F.filter(starts, lambda x: around(x["at"]).contains(word))
    return F.sort_array(F.array_distinct(F.transform(near, lambda x: F.substring(x["p"], 1, 4).cast("int"))))


def same_ids(a: Column, b: Column) -> Column:
    """Whether two maps hold the same entries, whatever their order."""
    order = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return order(a) == order(b)
