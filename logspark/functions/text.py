"""Text columns: redaction, normalisation, masks, levels, keywords, keys.

Patterns carry ``(?U)`` so that word boundaries and digit classes are Unicode-aware on every JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Secrets and personal data, in the order they are applied.
REDACTION_RULES: list[tuple[str, str, str]] = [
    ("JWT", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "<JWT>"),
    ("BEARER_TOKEN", r"(?i)(bearer\s+)[a-zA-Z0-9\-._~+/]+={0,2}", "$1<BEARER_TOKEN>"),
    ("AWS_ACCESS_KEY", r"(?i)\b(AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b", "<AWS_ACCESS_KEY>"),
    ("GENERIC_API_KEY", r"""(?i)(api[_-]?key\s*["=:]\s*["']?)([a-zA-Z0-9\-_]{16,})(["']?)""", "$1<GENERIC_API_KEY>$3"),
    ("PASSWORD", r"""(?i)(password\s*["=:]\s*["']?)([^\s,;"']+)(["']?)""", "$1<PASSWORD>$3"),
    ("SECRET", r"""(?i)(secret\s*["=:]\s*["']?)([^\s,;"']+)(["']?)""", "$1<SECRET>$3"),
    ("TOKEN", r"""(?i)(token\s*["=:]\s*["']?)([^\s,;"']+)(["']?)""", "$1<TOKEN>$3"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b", "<EMAIL>"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b", "<CREDIT_CARD>"),
    ("SSN", r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", "<SSN>"),
]

# Variable parts of a message, in the order they are replaced.
NORMALISATION_RULES: list[tuple[str, str]] = [
    ("UUID", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"),
    ("TIMESTAMP", r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b"),
    ("HEX", r"(?i)\b0x[0-9a-f]+\b|\b[0-9a-f]{10,}\b"),
    ("NUMBER", r"\b\d+\b"),
    ("ID_NUMBER", r"\d+"),
]

# Ids and digit runs hidden in a search pattern.
MASK_SHAPE = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]+)"

# Words that raise a cluster's severity.
P0_WORDS = (
    r"\b(crash(ed)?|oom.?kill|out.?of.?memory|sigsegv|segfault|kernel.?panic|fatal|deadlock|data.?loss|"
    r"data.?corruption|disk.?full|filesystem.?full|cannot.?allocate|illegal.?instruction|stack.?overflow|"
    r"heap.?overflow|double.?free|use.?after.?free)\b"
)
P1_WORDS = (
    r"\b(exception|error|failed|timeout|refused|unavailable|unreachable|circuit.?breaker|connection.?reset|"
    r"backpressure|throttl|rate.?limit|rollback|abort|panic)\b"
)


def redact(text: Column, enabled: bool = True) -> Column:
    """Replace secrets and personal data; labels such as ``password=`` stay."""
    if not enabled:
        return text
    return reduce(lambda c, rule: F.regexp_replace(c, "(?U)" + rule[1], rule[2]), REDACTION_RULES, text)


def redaction_hits(text: Column) -> list[tuple[str, Column]]:
    """Number of matches of every redaction rule in the text as it came."""
    return [(name, F.regexp_count(text, F.lit("(?U)" + shape))) for name, shape, _ in REDACTION_RULES]


def normalise(text: Column) -> Column:
    """Message -> template: variable parts become ``<NAME>``, white space is collapsed."""
    masked = reduce(
        lambda c, rule: F.regexp_replace(c, "(?U)" + rule[1], f"<{rule[0]}>"), NORMALISATION_RULES, text
    )
    return F.trim(F.regexp_replace(masked, r"(?U)\s+", " "))


def mask_pattern(text: Column) -> Column:
    """UUIDs and digit runs become ``*``."""
    return F.regexp_replace(text, MASK_SHAPE, "*")


def infer_level(message: Column, explicit: Column | None = None) -> Column:
    """The given level in upper case, else the one the message suggests."""
    upper = F.upper(message)
    guessed = (
        F.when(upper.contains("ERROR"), "ERROR")
        .when(upper.contains("WARN"), "WARN")
        .when(upper.contains("FATAL") | upper.contains("CRITICAL"), "ANOMALY")
        .otherwise("INFO")
    )
    return guessed if explicit is None else F.coalesce(F.upper(explicit), guessed)


def has_p0_word(text: Column) -> Column:
    return text.rlike("(?Ui)" + P0_WORDS)


def has_p1_word(text: Column) -> Column:
    return text.rlike("(?Ui)" + P1_WORDS)


def template_tokens(template: Column) -> Column:
    """Set of lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(template), F.lit("([a-z0-9]+)"), F.lit(1)))


def _short_sha(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8)


def alert_fingerprint(cluster_id: Column, priority: Column, source: Column) -> Column:
    return _short_sha(cluster_id, priority, source)


def destination_id(name: Column, url: Column) -> Column:
    return _short_sha(name, url)


def text_key(text: Column) -> Column:
    """Cache key of a template."""
    return F.md5(text)
