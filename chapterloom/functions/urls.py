"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
# RFC 3986, appendix B: scheme, authority, path, query and fragment.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:(.*)))?$"
# Fixed value: the name space of URLs for version 5 identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def host(url: Column) -> Column:
    """Lower-case host without user info or port; empty when there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def is_valid(url: Column) -> Column:
    trimmed = strip(url)
    return trimmed.rlike("(?i)^https?://") & (host(trimmed) != "")


def normalize(url: Column) -> Column:
    """Cut the fragment and all trailing slashes; the query stays."""
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/+$", "")


def normalize_for_site(url: Column, prefix_regex: Column) -> Column:
    """Also cut the query, then reduce to the site's own novel prefix if it matches.

    ``prefix_regex`` comes from the site rules and is anchored at the start;
    where it is null the plain form is kept.
    """
    plain = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    plain = F.regexp_replace(plain, "/+$", "")
    prefix = F.call_function("regexp_extract", plain, prefix_regex, F.lit(1))
    reduced = F.when(prefix != "", prefix).otherwise(plain)
    return F.when(prefix_regex.isNull(), normalize(url)).otherwise(reduced)


def entry_id(url: Column) -> Column:
    """Version 5 identifier of the exact URL string in the URL name space."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(url, "UTF-8"))
    )
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant,
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def _flat_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(walked, tail), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _inner_nonempty(segments: Column) -> Column:
    """Empty segments vanish, except the first and the last one."""
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment as an array."""
    first = F.regexp_extract(url, PARTS, 1)
    return F.array(F.lower(first), *[F.regexp_extract(url, PARTS, g) for g in range(2, 6)])


def resolve(base: Column, link: Column) -> Column:
    """A link found on page ``base`` as an absolute URL (RFC 3986, section 5)."""
    trimmed = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return let(
        F.struct(base.alias("base"), trimmed.alias("link"), _parts(base).alias("b"), _parts(trimmed).alias("l")),
        _resolved,
    )


def _resolved(u: Column) -> Column:
    scheme, authority, path, query, fragment = (F.get(u["l"], i) for i in range(5))
    base_scheme, base_authority, base_path, base_query = (F.get(u["b"], i) for i in range(4))

    def tail(q: Column, f: Column) -> Column:
        return F.concat(
            F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
            F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")),
        )

    def clean(target: Column) -> Column:
        # Only paths with dot segments need the walk.
        flat = F.when(target.rlike(r"(^|/)\.\.?(/|$)"), _flat_path(target)).otherwise(target)
        return let(flat, lambda t: F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)))

    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = F.split(F.concat(folder, path), "/")
    merged = F.array_join(let(joined, _inner_nonempty), "/")
    rooted = F.array_join(let(F.split(path, "/"), _inner_nonempty), "/")
    root = F.concat(base_scheme, F.lit("://"), base_authority)
    return (
        F.when(u["link"] == "", u["base"])
        .when(u["base"] == "", u["link"])
        .when((scheme != "") & (scheme != base_scheme), u["link"])
        .when(authority != "", F.concat(base_scheme, F.lit("://"), authority, path, tail(query, fragment)))
        .when(
            path == "",
            F.concat(root, base_path, tail(F.when(query != "", query).otherwise(base_query), fragment)),
        )
        # The common link needs neither merging nor walking.
        .when(
            path.startswith("/") & ~path.contains("//") & ~path.contains("/."),
            F.concat(root, path, tail(query, fragment)),
        )
        .when(path.startswith("/"), F.concat(root, let(rooted, clean), tail(query, fragment)))
        .otherwise(F.concat(root, let(merged, clean), tail(query, fragment)))
    )
