"""URL classes of a mirrored wiki. The hosts are parameters of the site, not part of the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import as_col


@dataclass(frozen=True)
class Site:
    """Hosts of one mirrored wiki."""

    mirror: str = "mirror.example"  # mirror domain; sub-domains included
    asset_domains: tuple[str, ...] = ("wiki.example", "cdnhost.example", "mirror.example")
    file_host: str = "file.mirror.example"  # serves /file/<hash>
    file_fan_out: tuple[str, ...] = ("www.", "", "dark.", "d.", "m.")  # sub-domains that serve the same files
    cdn_alias: tuple[str, str] = ("w.cdnhost.example", "i.wiki.example")  # old host -> current host
    own_hosts: tuple[str, ...] = ("mirror.example", "wiki.example")
    wiki_path: str = "/w/"

    @property
    def link_prefix(self) -> str:
        """Regex for the start of an internal link."""
        return rf"(?:https?://(?:www\.)?{self.mirror.replace('.', chr(92) + '.')})?{self.wiki_path}"


SITE = Site()


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(as_col(url), F.lit("HOST")))


def path(url: Column | str) -> Column:
    return F.try_parse_url(as_col(url), F.lit("PATH"))


def in_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def is_non_payload(url: Column | str, site: Site = SITE) -> Column:
    """Mirror navigation and presentation addresses, which never carry the file that was asked for."""
    p = path(url)
    hit = in_domain(host(url), site.mirror) & p.rlike(r"(?i)^/(?:images|xref|w|RecentChanges|Search)(?:/|$)")
    return F.coalesce(hit, F.lit(False))


def is_asset_candidate(url: Column | str, site: Site = SITE) -> Column:
    """Addresses on an allowed host that look like a file: a /i/ or /file/ path, or an image extension."""
    h, p, u = host(url), path(url), as_col(url)
    allowed = F.lit(False)
    for d in site.asset_domains:
        allowed = allowed | in_domain(h, d)
    blocked = p.rlike(r"^/w/") | p.rlike(r"(?i)^/(?:RecentChanges|Search|xref|images)(?:/|$)")
    shaped = p.rlike(r"(?i)/(?:i|file)/") | u.rlike(r"(?i)\.(?:jpe?g|png|webp|gif|avif|svg)(?:$|[?#])")
    return F.coalesce(allowed & ~is_non_payload(u, site) & ~blocked & shaped, F.lit(False))


def remote_candidates(url: Column | str, site: Site = SITE) -> Column:
    """The address itself plus the other hosts that serve the same file; empty for non-payload addresses."""
    u = as_col(url)
    tail = F.regexp_replace(u, r"^[a-zA-Z]+://[^/?#]+|#.*$", "")
    fan = [F.concat(F.lit(f"https://{sub}{site.mirror}"), tail) for sub in site.file_fan_out]
    on_file_host = (host(u) == site.file_host) & path(u).startswith("/file/")
    old, new = site.cdn_alias
    out = F.concat(
        F.array(u),
        F.when(F.coalesce(on_file_host, F.lit(False)), F.array(*fan)).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(host(u) == old, F.lit(False)), F.array(F.concat(F.lit(f"https://{new}"), tail))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return F.when(is_non_payload(u, site), F.array().cast("array<string>")).otherwise(
        F.filter(F.array_distinct(out), lambda x: ~is_non_payload(x, site))
    )


def percent_decode(c: Column) -> Column:
    """Percent-decoding that keeps ``+``; malformed input stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def percent_encode(c: Column) -> Column:
    """Percent-encoding of one path segment; blanks become %20 and ``!'()*~`` stay."""
    out = F.url_encode(c)
    for enc, raw in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, enc, raw)
    return out


def wiki_url(base: str, title: Column) -> Column:
    """Address of a title: every path segment percent-encoded."""
    return F.concat(F.lit(base), F.array_join(F.transform(F.split(title, "/"), percent_encode), "/"))
