"""URL expressions: validation, scheme prefixing, host, RFC 3986 join.

All native Catalyst expressions; the dot-segment walk is an ``aggregate``
fold over the path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"
# Characters ``urlsplit`` strips in front (C0 controls and space) and the
# ones it removes anywhere (tab, CR, LF).
_LEADING_JUNK = "^[\\x00-\\x20]+"
_UNSAFE = "[\\t\\r\\n]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(url) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(url), _UNSAFE, ""), _LEADING_JUNK, "")


def netloc(url) -> Column:
    """Network location of an absolute URL ('' when there is none)."""
    return F.regexp_extract(_clean(url), f"^{_SCHEME}://([^/?#]*)", 1)


def validate_url(url) -> Column:
    """A4: scheme and network location both non-empty; brackets in the host
    balanced; leading blanks ignored. NULL input is invalid."""
    u = _clean(url)
    loc = F.regexp_extract(u, f"^{_SCHEME}://([^/?#]*)", 1)
    ok = u.rlike(f"^{_SCHEME}://[^/?#]+") & (loc.contains("[") == loc.contains("]"))
    return F.coalesce(ok, F.lit(False))


def with_scheme(url) -> Column:
    """Prefix ``https://`` unless the URL starts with http:// or https://."""
    u = _c(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def selector_list(c) -> Column:
    """Comma list, stripped, empties dropped (as a column)."""
    return F.coalesce(F.filter(F.transform(F.split(_c(c), ","), strip_ws), lambda x: x != ""),
                      F.array().cast("array<string>"))


def parse_selector_list(s: str | None) -> list[str]:
    """A8, driver form for option parsing."""
    return [p.strip() for p in s.split(",") if p.strip()] if s else []


def host(url) -> Column:
    """Lower-cased host of an absolute URL, without user info and port."""
    loc = netloc(url)
    return F.lower(F.regexp_extract(loc, "^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)", 1))


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_clean(url), f"^({_SCHEME}):", 1))


def _let(x: Column, of) -> Column:
    """``of(x)`` with ``x`` evaluated once, however often ``of`` names it (an expression is otherwise repeated)."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def absolute_url(base, rel) -> Column:
    """F8: '' stays ''; http(s) URLs are kept; ``//host`` takes the base
    scheme; anything else is joined to the base per RFC 3986 with
    ``urljoin`` conventions (empty inner segments dropped)."""
    base = _c(base)
    rel = _c(rel)
    b_scheme = scheme(base)
    b_loc = netloc(base)
    b_rest = F.regexp_extract(_clean(base), f"^{_SCHEME}://[^/?#]*(.*)$", 1)
    b_path = F.regexp_extract(b_rest, "^([^?#]*)", 1)
    b_query = F.regexp_extract(b_rest, "^[^?#]*\\?([^#]*)", 1)

    r_path = F.regexp_extract(rel, "^([^?#]*)", 1)
    r_has_q = rel.rlike("^[^#]*\\?")
    r_query = F.regexp_extract(rel, "^[^?#]*\\?([^#]*)", 1)
    r_frag = F.regexp_extract(rel, "^[^#]*#(.*)$", 1)

    base_dir = F.split(b_path, "/")
    base_dir = F.when(F.try_element_at(base_dir, F.lit(-1)) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(base_dir)
    # A rooted path ignores the base path; only a relative one drops empty
    # inner segments.
    segs = F.when(r_path.startswith("/"), F.split(r_path, "/")).otherwise(F.concat(base_dir, F.split(r_path, "/")))
    rooted = r_path.startswith("/")

    def without_empty(p: Column) -> Column:
        return F.when((F.size(p) >= 2) & ~rooted, F.concat(
            F.slice(p, 1, 1), F.filter(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda s: s != ""), F.slice(p, -1, 1))).otherwise(p)

    def fold(p: Column) -> Column:
        kept = F.aggregate(
            p, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))))
        return F.concat(kept, F.when(F.try_element_at(p, F.lit(-1)).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")))

    def rooted_path(p: Column) -> Column:
        return F.when(p == "", F.lit("/")).when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))

    path = _let(segs, lambda p: _let(without_empty(p), lambda q: _let(F.array_join(fold(q), "/"), rooted_path)))

    empty_path = r_path == ""
    out_path = F.when(empty_path, b_path).otherwise(path)
    out_query = F.when(empty_path & ~(r_has_q & (r_query != "")), b_query).otherwise(r_query)
    joined = F.concat(
        b_scheme, F.lit("://"), b_loc, out_path,
        F.when(out_query != "", F.concat(F.lit("?"), out_query)).otherwise(F.lit("")),
        F.when(r_frag != "", F.concat(F.lit("#"), r_frag)).otherwise(F.lit("")))

    has_scheme = rel.rlike(f"^{_SCHEME}:")
    same_scheme_abs = has_scheme & (scheme(rel) == b_scheme) & rel.rlike(f"^{_SCHEME}://")
    return (F.when(rel.isNull() | (rel == ""), F.lit(""))
            .when(rel.startswith("http://") | rel.startswith("https://"), rel)
            .when(rel.startswith("//"), F.concat(b_scheme, F.lit(":"), rel))
            .when(same_scheme_abs, F.concat(b_scheme, F.regexp_extract(rel, f"^{_SCHEME}(:.*)$", 1)))
            .when(has_scheme, rel)
            .otherwise(joined))
