"""Parameters as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.5
    b: float = 0.75
    k3: float = 1.5


@dataclass(frozen=True)
class RolePolicy:
    """Months of history that a role sees; None: everything."""

    months: dict[str, int | None] = field(default_factory=lambda: {"Administrator": None, "VerifiedUser": 36, "SignedUser": 12, "Guest": 1})
    anonymous: str = "Guest"
    without_role: str = "SignedUser"


@dataclass(frozen=True)
class CrawlRules:
    hosts: tuple[str, ...] = ()
    follow_prefixes: tuple[str, ...] = ()
    attachments: tuple[str, ...] = ("xls", "doc", "docx", "txt", "xlsx", "pdf")
    title_tag: str = "h3"


STOP_WORDS = {
    "en": ("the", "of", "and", "a", "to", "in", "is", "was", "that", "for", "on", "with", "as", "by", "are", "this", "be", "it", "from", "or"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "des", "dem"),
    "fr": ("le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "que", "qui", "pour", "dans", "sur"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "se"),
}
