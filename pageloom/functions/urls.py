"""Reference resolution against a page URL, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _drop_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    cleaned = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), cleaned).otherwise(path)


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """Absolute URL of ``ref`` as found on the page at ``base``.

    A relative reference replaces the base's last path segment, so a base that
    should be kept whole must end in ``/``.
    """
    base, ref = _col(base), _col(ref)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    base_path = F.regexp_replace(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)

    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    # Joining drops empty segments; an absolute path keeps its own.
    joined = F.regexp_replace(F.concat(folder, ref_path), "/+", "/")
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(origin, _drop_dots(ref_path), ref_tail))
        .when(ref.startswith("?"), F.concat(no_query, ref))
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .otherwise(F.concat(origin, _drop_dots(joined), ref_tail))
    )
