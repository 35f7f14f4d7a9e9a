"""Request predicates and features as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decoded_twice

#: Patterns of SQL-like syntax in a request.
INJECTION = [
    r"\bunion\s+(?:all\s+)?select\b",
    r"\bor\b\s+['\"]?\w+['\"]?\s*=\s*['\"]?\w+",
    r"'\s*or\s*'[^']*'\s*=\s*'[^']*",
    r"\bwaitfor\s+delay\b",
    r"\bsleep\s*\(",
    r";\s*drop\s+table\b",
    r"--\s*(?:$|\w)",
]
#: Request buckets and indicator patterns of the feature vector.
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OTHER"]
PATHS = ["api_search", "login", "ftp", "product_search", "root", "other"]
STATUSES = ["2xx", "3xx", "4xx", "5xx", "other"]
SQL_WORDS = r"\b(union|select|insert|update|delete)\b|'\s*(or|and)\b|--|/\*|\b1\s*=\s*1\b"
SCRIPT = r"<\s*script|<\s*svg|\bonload\s*=|alert\s*\("
TRAVERSAL = r"\.\.[/\\]"
SPECIAL = r"['\"<>;]"
QUERY_MOST = 512

REQUEST_KEYS = ["query", "path", "url", "request", "message", "body"]
TEXT_KEYS = ["method", "path", "query", "url", "request", "message", "user_agent"]


def attribute(key: str) -> Column:
    return F.element_at("attributes", F.lit(key))


def event_text() -> Column:
    """All that an event says, decoded and in lower case."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "event_type", "action", "source_entity", "destination_entity")]
    return F.lower(decoded_twice(F.concat_ws(" ", *said, *[F.coalesce(attribute(k), F.lit("")) for k in TEXT_KEYS])))


def injection_like(text: Column) -> Column:
    out = F.lit(False)
    for pattern in INJECTION:
        out = out | text.rlike("(?i)" + pattern)
    return out


def suspicious() -> Column:
    """SQL-like syntax in an event's request text, or in all its text where that is blank."""
    asked = decoded_twice(F.lower(F.concat_ws(" ", *[F.coalesce(attribute(k), F.lit("")) for k in REQUEST_KEYS])))
    return injection_like(F.when(F.trim(asked) == "", event_text()).otherwise(asked))


def stage(found: Column) -> Column:
    """Activity label of an event, by the first rule that holds."""
    kind, source, action = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("event_type", "source", "action"))
    where = F.concat_ws(" ", kind, source)
    asked = F.concat(F.coalesce(attribute("method"), F.lit("")), F.coalesce(attribute("path"), F.lit("")))
    return (
        F.when(found, "exploitation_attempt_indicator")
        .when(F.concat_ws(" ", where, action).rlike("auth|login|ssh"), "authentication_activity_observed")
        .when((asked != "") | kind.contains("http"), "web_request_observed")
        .when(where.rlike("packet|network|pcap|tcp|udp"), "network_activity_observed")
        .when(where.rlike("docker|container|process"), "system_state_or_process_event")
        .otherwise("unclassified_event")
    )


def interpretation(label: Column) -> Column:
    return (
        F.when(label == "exploitation_attempt_indicator", "attempt_indicator_observed_success_unconfirmed")
        .when(label == "authentication_activity_observed", "activity_observed_outcome_requires_evidence")
        .when(label == "unclassified_event", "observed_event_stage_unknown")
        .otherwise("activity_observed")
    )


def method_bucket(method: Column) -> Column:
    m = F.upper(F.coalesce(method, F.lit("")))
    return F.when(m.isin(METHODS[:-1]), m).otherwise("OTHER")


def path_bucket(path: Column) -> Column:
    p = F.lower(F.substring_index(F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), "?", 1))
    return (
        F.when(p == "/api/search", "api_search")
        .when(p.contains("login"), "login")
        .when(p.startswith("/ftp"), "ftp")
        .when(p.contains("product"), "product_search")
        .when(p.isin("", "/"), "root")
        .otherwise("other")
    )


def status_bucket(status: Column) -> Column:
    s = F.try_to_number(status.cast("string"), F.lit("999")).cast("int")
    return F.when(s.between(200, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))).otherwise("other")


def features(method: Column, path: Column, query: Column, status: Column) -> Column:
    """One-hot buckets and query indicators of a request as an array of doubles."""
    q = F.coalesce(query, F.lit(""))
    plain = decoded_twice(q)
    low = F.lower(plain)
    hot = [method_bucket(method) == m for m in METHODS] + [path_bucket(path) == p for p in PATHS] + [status_bucket(status) == s for s in STATUSES]
    marks = [q != "", low.rlike(SQL_WORDS), low.rlike(SCRIPT), low.rlike(TRAVERSAL), plain.rlike(SPECIAL)]
    return F.array(*[x.cast("double") for x in [*hot, *marks]], F.least(F.length(q), F.lit(QUERY_MOST)) / F.lit(float(QUERY_MOST)))
