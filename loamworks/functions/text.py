"""Text expressions: search terms, identifiers, tokens, windows of lines, secrets. All of them run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a query that count, and characters of a token.
MAX_TERMS = 20
TERM = r"[\p{L}\p{N}_$-]{2,}"
TOKEN = r"[\p{L}\p{N}_$]+"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
LINE_END = r"\r?\n"


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they fold to, by their canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()

# The patterns of texts that are withheld, each with what stands in its place.
SECRETS = (
    (r"(?is)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED]"),
    (r"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|password|client[_-]?secret)(["']?\s*[:=]\s*)["']?[^\s"']{8,}""", "$1$2[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "[REDACTED]"),
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEX_TOKEN = r"\b[0-9a-fA-F]{32,}\b"
LOCAL_PATH = r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[A-Za-z0-9._-]+"


def query_terms(text: Column) -> Column:
    """The first distinct terms of a query, in lower case; null gives null."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)), 1, MAX_TERMS)


def identifier_parts(text: Column) -> Column:
    """Parts of the identifiers in a text, split where the case changes and at ``_`` and ``$``; single letters are left out."""
    ids = F.array_join(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0), " ")
    return F.filter(F.split(F.regexp_replace(ids, "([a-z0-9])([A-Z])", "$1 $2"), r"[_$\s]+"), lambda x: F.length(x) > 1)


def lexical_body(text: Column) -> Column:
    """The text followed by the parts of its identifiers, as it is indexed."""
    return F.concat(text, F.lit("\n"), F.array_join(identifier_parts(text), " "))


def tokens(text: Column) -> Column:
    """Tokens in lower case without Latin marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(TOKEN), 0)


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def contains_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _ in SECRETS:
        found = found | text.rlike(pattern)
    return found


def redact(text: Column) -> Column:
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead)
    return text
