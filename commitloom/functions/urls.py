"""Column functions that canonicalise repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rewrites that make equal repositories equal strings, in order.
_IDENTITY_RULES = [
    (r"^git@([^:]+):", "https://$1/"),
    (r"^ssh://git@", "https://"),
    (r"^http://", "https://"),
    (r"^https://www\.", "https://"),
    (r"/+$", ""),
    (r"\.git$", ""),
]


def normalize_repo_url(url: Column) -> Column:
    """Expand ``owner/repo``, drop browse suffixes and add ``.git`` on the known hosts."""
    s = F.regexp_replace(F.trim(url), r"/+$", "")
    s = F.when(s.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), s)).otherwise(s)
    s = F.regexp_replace(
        s, r"^(https?://(?:www\.)?github\.com/[^/]+/[^/]+)/(tree|blob)/.*$", "$1"
    )
    hosted = s.rlike(r"^https?://(www\.)?(github|gitlab)\.com/[^/]+/[^/.]+$")
    return F.when(hosted, F.concat(s, F.lit(".git"))).otherwise(s)


def repo_key(url: Column) -> Column:
    s = F.trim(url)
    for pattern, replacement in _IDENTITY_RULES:
        s = F.regexp_replace(s, pattern, replacement)
    return F.lower(s)


def repo_name(url: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), r"/+$", "")
    parts = F.filter(F.split(clean, r"[/:\\]"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(F.size(parts) > 0, F.array_join(last, "/")).otherwise(clean)
