"""Column names: which leaf paths are kept, and what they are called."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Path patterns and the names they become, applied in this order. A dot matches any character and a
# pattern matches anywhere in the path, so these are rules of the data format and not mere spellings.
RENAMES = [
    ("application.package_name", "package_name"),
    ("application.title", "app_title"),
    ("application.version_code", "app_version_code"),
    ("application.app_id", "app_id"),
    ("application.cognito_identity_pool_id", "cognito_identity_pool_id"),
    ("application.version_name", "app_version_name"),
    ("application.sdk.version", "sdk_version"),
    ("application.sdk.name", "sdk_name"),
    ("session.session_id", "session_id"),
    ("device.locale.country", "country"),
    ('device.locale.code"', "locale"),
    ("device.locale.language", "language"),
    ("device.platform.version", "platform_version"),
    ("device.platform.name", "platform"),
    ("device.make", "make"),
    ("device.model", "model"),
    ("client.cognito_id", "cognito_id"),
    ("client.client_id", "client_id"),
    ("attributes.user_id", "user_id"),
]

# What a kept path has not, and what a name leaves out.
_REJECTED = re.compile(r"[A-Z\s]")
_NOT_IN_A_NAME = re.compile(r"[^A-Za-z0-9,._]")


def keeps_path(path: str) -> bool:
    """A path is dropped if any part of it holds an ASCII capital or whitespace."""
    return _REJECTED.search(path) is None


def column_name(path: str, fix_locale: bool = False) -> str:
    """Name of the flat column for a dotted leaf path.

    The stray quote in the locale rule keeps it from ever matching; ``fix_locale`` drops the quote.
    """
    name = path
    for pattern, replacement in RENAMES:
        if fix_locale:
            pattern = pattern.rstrip('"')
        name = re.sub(pattern, replacement, name)
    return _NOT_IN_A_NAME.sub("", name).replace(".", "_")


def check_distinct(paths: Iterable[str], names: Iterable[str]) -> None:
    """Raise before any job starts if two paths would become one column."""
    sources: dict[str, list[str]] = {}
    for path, name in zip(paths, names, strict=True):
        sources.setdefault(name, []).append(path)
    clashes = {name: found for name, found in sources.items() if len(found) > 1}
    if clashes:
        raise ValueError(f"different fields would share one column name: {clashes}")
