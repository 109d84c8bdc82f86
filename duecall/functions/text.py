"""Column builders over text: normal forms, tokens, pages, URLs, identifiers.

Regular expressions keep to what Java and RE2 read alike: no look-around, and word
bounds spelled out on text that is already ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP_WORDS = "a about all am an and any are around at be for from give have i im in is it looking me my need of on or please show that the to want where which with work working".split()
PAPER_STOP_WORDS = "a an and are at for from in is of on or the to with".split()


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Of all characters whose compatibility decomposition without accents has ASCII in it: those of one letter, and
    those of more, as ligatures, numerals, units and fractions are."""
    one, many = {}, {}
    for k in (*range(0xA0, 0xD800), *range(0xE000, 0x20000)):  # no later plane has any
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not "\u0300" <= c <= "\u036f")
        if plain != chr(k) and any(c.isascii() and c.isprintable() for c in plain):
            (one if len(plain) == 1 else many)[chr(k)] = plain
    return "".join(one), "".join(one.values()), many


_FROM, _TO, _LONG = _decomposed()
#: Characters that become several, and pairs of them and what they become, each as one text; none holds the two marks.
_KEYS = "\u0001".join(_LONG)
_PAIRS = "\u0001".join(f"{k}\u0002{v}" for k, v in _LONG.items())


def folded(text: Column | str) -> Column:
    """Compatibility-decomposed, without accents, as far as the result has ASCII in it; other scripts lose combining marks only.

    Of a text that isn't ASCII its distinct other characters are looked up, so a text is read a few times, whatever the table's size."""
    text = F.col(text) if isinstance(text, str) else text
    plain = lambda c: F.regexp_replace(F.translate(c, _FROM, _TO), "[\u0300-\u036f]", "")
    table = F.str_to_map(F.lit(_PAIRS), F.lit("\u0001"), F.lit("\u0002"))
    other = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]"), F.lit(0)))
    longer = F.array_intersect(other, F.split(F.lit(_KEYS), "\u0001"))
    apart = lambda found: F.when(F.size(found) > 0, F.reduce(found, text, lambda done, c: F.replace(done, c, F.element_at(table, c)))).otherwise(text)
    return F.when(~text.rlike(r"[^\x00-\x7f]"), text).otherwise(plain(let(longer, apart)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, which no optimizer rule inlines."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def search_text(text: Column) -> Column:
    """Without accents, lower case; letters, digits and ``+#./-``; single blanks."""
    return squeezed(F.regexp_replace(F.lower(folded(F.coalesce(text, F.lit("")))), r"[^a-z0-9+#./-]+", " "))


def name_text(text: Column, years: bool = True, ampersand: bool = True, centuries: str = "19|20") -> Column:
    """Lower-case letters and digits; optionally without years (of these centuries) and with & as "and". A number that an underscore joins to a word is no year."""
    out = F.lower(folded(F.coalesce(text, F.lit(""))))
    if ampersand:
        out = F.regexp_replace(out, "&", " and ")
    if not years:
        out = F.regexp_replace(out, rf"(?<![a-z0-9_])(?:{centuries})[0-9][0-9](?![a-z0-9_])", " ")
    return squeezed(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def acronym(text: Column, centuries: str = "19|20") -> Column:
    """Without years, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<![A-Za-z0-9_])(?:{centuries})[0-9][0-9](?![A-Za-z0-9_])", "")), r"[^a-z0-9]", "")


def tokens(normal: Column, least: int = 2, digits: bool = True, stop: list[str] | None = None) -> Column:
    """Words of a normal form: edge ``./-`` stripped, stop words and short words dropped; digits may stay at any length."""
    words = F.split(F.regexp_replace(normal, r"(?<![^ ])[./-]+|[./-]+(?![^ ])", ""), " ")
    long = lambda w: (F.length(w) >= least) | (w.rlike("^[0-9]+$") if digits else F.lit(False))
    stop = STOP_WORDS if stop is None else stop
    return F.filter(words, lambda w: (w != "") & long(w) & ~w.isin(stop) if stop else (w != "") & long(w))


def html_text(html: Column) -> Column:
    """A page's visible text: no scripts, styles or comments; tags as blanks; a few entities decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def host(url: Column) -> Column:
    """The host in lower case without www., or null where there is no http(s) URL."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))), r"^www\.", "")


def safe_url(url: Column) -> Column:
    """The trimmed URL if it is http or https with a host, else null."""
    return F.when(F.trim(url).rlike(r"^(?i:https?)://[^/?#@ ]+"), F.trim(url))


def normal_url(url: Column) -> Column:
    """A safe URL in normal form: scheme and host in lower case, no usual port, a path; else null."""
    safe = safe_url(url)
    scheme, name = F.lower(F.regexp_extract(safe, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(safe, r"^[A-Za-z]+://([^/?#]*)", 1))
    name = F.when(scheme == "http", F.regexp_replace(name, ":80$", "")).otherwise(F.regexp_replace(name, ":443$", ""))
    rest = F.regexp_extract(safe, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    return F.concat(scheme, F.lit("://"), name, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def allowed(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of domains or below one."""
    return F.coalesce(F.lit(False), *[]) if not domains else F.coalesce(F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d))), F.lit(False))


def links(html: Column) -> Column:
    """array<struct(href, text)> of a page's anchors, in order."""
    pattern = r"""(?is)<a [^>]*href=(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>"""
    part = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    return F.zip_with(
        F.zip_with(part(1), part(2), lambda a, b: F.when(a != "", a).otherwise(b)),
        part(3),
        lambda a, t: F.struct(a.alias("href"), squeezed(F.regexp_replace(t, "<[^>]*>", " ")).alias("text")),
    )


def resolved(href: Column, base: Column) -> Column:
    """An absolute URL of href on the page at base; root-relative, scheme-relative, query, fragment and path links."""
    scheme = F.regexp_extract(base, r"^(https?):", 1)
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page.rlike(r"^https?://[^/]+/"), F.regexp_extract(page, r"^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(href.rlike("^(?i:https?)://"), href)
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike("^[?#]") | (href == ""), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )


def doi(text: Column) -> Column:
    """A DOI in lower case without its resolver, or null where the shape is wrong."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:[ ]*)", "")
    bare = F.regexp_replace(bare, r"[.,;)\]]+$", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), bare)


def issn(text: Column) -> Column:
    """An ISSN as 1234-567X if its check digit is right, else null."""
    bare = F.upper(F.regexp_replace(text, r"[^0-9xX]", ""))
    digit = lambda k: F.substring(bare, k, 1).try_cast("int")
    total = sum((digit(k) * (9 - k) for k in range(2, 8)), digit(1) * 8)
    check = F.when(F.substring(bare, 8, 1) == "X", 10).otherwise(digit(8))
    ok = bare.rlike("^[0-9]{7}[0-9X]$") & ((total + check) % 11 == 0)
    return F.when(ok, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4)))


def orcid(text: Column) -> Column:
    """An ORCID as 0000-0000-0000-000X if its check digit is right, else null."""
    bare = F.regexp_extract(F.upper(text), r"([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])", 1)
    digits = F.replace(bare, F.lit("-"), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda n, k: (n + F.substr(digits, k, F.lit(1)).try_cast("int")) * 2 % 11)
    check = (12 - total) % 11
    return F.when((bare != "") & (F.right(bare, F.lit(1)) == F.when(check == 10, "X").otherwise(check.cast("string"))), bare)


def redirected(href: Column, parameter: str) -> Column:
    """The address that a search result's link leads to: its redirect parameter decoded, else itself."""
    inner = F.regexp_extract(href, rf"[?&]{parameter}=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(href)


def loose_json(text: Column) -> Column:
    """What stands between a text's first and last brace, if that is JSON, else null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def unwrapped(text: Column, deepest: int = 5) -> Column:
    """What is wrapped in {"value": ...}, however often up to a depth, as text; what isn't JSON stays as it is."""
    value = F.try_parse_json(text)
    inner = [F.try_variant_get(value, "$" + ".value" * k, "string") for k in range(deepest, -1, -1)]
    return F.coalesce(*inner, text)


def slug(text: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def ruled(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first rule (label, pattern) that matches, else other."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All labels whose pattern matches, in the rules' order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules)))


def jaccard(a: Column, b: Column) -> Column:
    """|A & B| / |A | B| of two arrays as sets, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """|A & B| / min(|A|, |B|)."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def largest_share(a: Column, b: Column) -> Column:
    """|A & B| / max(|A|, |B|)."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def contained(a: Column, b: Column) -> Column:
    """The share of A's elements that B has."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def xml_text(text: Column) -> Column:
    """XML character data: entities decoded, tags dropped."""
    out = F.regexp_replace(text, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def latex_text(text: Column) -> Column:
    """BibTeX field text: accent commands and braces dropped, ties as blanks."""
    out = F.regexp_replace(text, r"\\[`'^\"~=.uvHtcdb]\{?([A-Za-z])\}?", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+ ?", "")
    return squeezed(F.regexp_replace(F.regexp_replace(out, "[{}]", ""), "~|--+", " "))
