"""Column functions for single values: times, casts, addresses, labels, hashes."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Timestamp layouts, tried in this order after the general ISO parse.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSX",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "yyyyMMddHHmmss",
]

# Syslog facility and severity names by code.
FACILITIES = [
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "security", "console", "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5",
    "local6", "local7",
]
SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]

# Windows event levels and security event ids.
WINDOWS_LEVELS = {0: "unknown", 1: "critical", 2: "error", 3: "warning", 4: "info", 5: "verbose"}
SECURITY_EVENTS = {
    4624: "successful_login",
    4625: "failed_login",
    4634: "account_logoff",
    4648: "explicit_credential_login",
    4720: "account_created",
    4722: "account_enabled",
    4723: "password_change",
    4724: "password_reset",
    4725: "account_disabled",
    4726: "account_deleted",
    4728: "member_added_to_security_group",
    4732: "member_added_to_local_group",
    4740: "account_locked_out",
    4767: "account_unlocked",
}

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# The patterns for addresses inside text and for a domain name.
IPV4_IN_TEXT = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

SEVERITY_THRESHOLDS = {"critical": 0.95, "high": 0.85, "medium": 0.7, "low": 0.5}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels(mapping: dict, key: Column) -> Column:
    """Lookup in a small fixed map; null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def dash_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def group(text: Column, pattern: str, i: int) -> Column:
    """Regex group, null when the pattern or the group does not match."""
    return empty_to_null(F.regexp_extract(text, pattern, i))


# P01
def parse_ts(c: Column | str, formats: list[str] | None = None) -> Column:
    """General ISO parse, then the listed formats; times without a zone are UTC; else null."""
    c = col(c)
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in (formats or TIMESTAMP_FORMATS)]
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
    return F.coalesce(iso, *tries)


def epoch_to_ts(c: Column | str) -> Column:
    """Epoch seconds, or milliseconds when the number exceeds 1e12."""
    c = col(c).cast("double")
    return F.timestamp_micros(F.round(F.when(c > 1e12, c / 1000).otherwise(c) * 1e6).cast("bigint"))


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def cast_lenient(c: Column | str, kind: str) -> Column:
    """Int (through double when it has a dot), float, bool or str; null when impossible.

    A typed column cannot hold the original text, so ``kept_original`` keeps it beside.
    """
    c = col(c).cast("string")
    if kind == "int":
        return F.when(c.contains("."), c.try_cast("double").try_cast("bigint")).otherwise(c.try_cast("bigint"))
    if kind == "float":
        return c.try_cast("double")
    if kind == "bool":
        return F.lower(c).isin("true", "yes", "y", "1")
    return c


def kept_original(c: Column | str, kind: str) -> Column:
    """The original text where the lenient cast fails."""
    return F.when(cast_lenient(c, kind).isNull(), col(c).cast("string"))


# P04
def valid_ipv4(c: Column | str) -> Column:
    """The address when it is a canonical IPv4, else null; stays in the JVM."""
    c = col(c)
    return F.when(c.rlike(IPV4), c)


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def valid_ip(c: Column | str) -> Column:
    """Canonical IPv4 or IPv6, else null; only texts with a colon need the Arrow function."""
    c = col(c)
    return F.coalesce(valid_ipv4(c), _canonical(F.when(c.contains(":"), c)))


@F.pandas_udf(T.StringType())
def _ipv6_hex(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return ipaddress.IPv6Address(text).packed.hex()
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def ip_bits(c: Column | str) -> Column:
    """An address as (family, hi, lo): 64 bits each, an IPv4 number in front; null when the text is no address.

    Masking a prefix then is cutting bits, for both families alike; only texts with a colon need the Arrow function.
    """
    c = col(c)
    six = _ipv6_hex(F.when(c.contains(":"), c))
    half = lambda at: F.conv(F.substring(six, at, 16), 16, -10).cast("bigint")
    bits = lambda family, hi, lo: F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))
    four = F.when(c.rlike(IPV4), bits(4, F.shiftleft(ip_to_long(c), 32), F.lit(0).cast("bigint")))
    return F.coalesce(four, F.when(six.isNotNull(), bits(6, half(1), half(17))))


def masked_bits(bits: Column, length: Column) -> Column:
    """The network part: the first ``length`` bits, the rest zero."""
    # All 64 bits are cut at once by a shift of 64, which the engine takes modulo 64: so none is asked for by a condition.
    head = lambda n: F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - F.least(n, F.lit(64))).cast("int")))
    return F.struct(bits["family"].alias("family"), bits["hi"].bitwiseAND(head(length)).alias("hi"),
                    bits["lo"].bitwiseAND(head(length - 64)).alias("lo"))


def ip_to_long(c: Column | str) -> Column:
    parts = F.split(col(c), r"\.")
    return sum((F.get(parts, F.lit(i)).cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))


# P10
def facility(pri: Column) -> Column:
    """P10: facility name of a syslog priority, ``facilityN`` when unknown."""
    code = F.floor(pri / 8).cast("int")
    return F.coalesce(labels(dict(enumerate(FACILITIES)), code), F.concat(F.lit("facility"), code.cast("string")))


def severity_name(pri: Column) -> Column:
    """P10: severity name of a syslog priority."""
    return labels(dict(enumerate(SEVERITIES)), (pri % 8).cast("int"))


# P14
def event_type_from_process(process: Column | str) -> Column:
    """Event type from the process name."""
    p = F.lower(col(process))
    has = lambda *words: F.coalesce(sum((p.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return (F.when(has("ssh", "auth", "login"), "auth").when(has("firewall", "iptables"), "firewall")
            .when(has("nginx", "apache"), "webserver").when(has("kernel"), "system"))


# P22-P24
def parse_request(c: Column | str) -> Column:
    """struct(method, path, protocol) of an HTTP request line, '' when a part is missing."""
    parts = F.split(F.trim(col(c)), r"\s+")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(part(0).alias("method"), part(1).alias("path"), part(2).alias("protocol"))


def parse_ua(c: Column | str) -> Column:
    """struct(browser, os, is_mobile) of a user agent."""
    ua = col(c)
    has = ua.contains
    # Labels and their order of precedence.
    browser = (F.when(has("Chrome") & has("Safari"), "Chrome").when(has("Firefox"), "Firefox")
               .when(has("Safari"), "Safari").when(has("Edge"), "Edge")
               .when(has("MSIE") | has("Trident"), "Internet Explorer").otherwise("Other"))
    os_name = (F.when(has("Windows"), "Windows").when(has("Android"), "Android")
               .when(has("iPhone") | has("iPad"), "iOS").when(has("Mac OS"), "macOS")
               .when(has("Linux"), "Linux").otherwise("Other"))
    mobile = ua.rlike("Mobile|Android|iPhone|iPad")
    return F.struct(browser.alias("browser"), os_name.alias("os"), mobile.alias("is_mobile"))


def status_class(c: Column | str) -> Column:
    """Class of an HTTP status code."""
    c = col(c)
    names = ["informational", "success", "redirect", "client_error", "server_error"]
    return F.get(F.array(*[F.lit(n) for n in names]), F.when(c.between(100, 599), F.floor(c / 100) - 1).cast("int"))


# P26, P27
def windows_severity(level: Column | str) -> Column:
    """Severity of a Windows level, 'unknown' for other numbers, null for text."""
    n = col(level).cast("string").try_cast("int")
    return F.when(n.isNotNull(), F.coalesce(labels(WINDOWS_LEVELS, n), F.lit("unknown")))


def security_event(event_id: Column | str) -> Column:
    """Name of a known security event id."""
    return labels(SECURITY_EVENTS, col(event_id).cast("string").try_cast("int"))


def valid_domain(c: Column | str) -> Column:
    """Whether the text is a domain name."""
    return col(c).rlike(DOMAIN)


def sha256(c: Column | str) -> Column:
    """SHA-256 hex of a text or binary column."""
    return F.sha2(col(c), 256)


def severity(score: Column | str, thresholds: dict[str, float] | None = None) -> Column:
    """Severity of a score in 0..1; 'normal' below every threshold."""
    t = thresholds or SEVERITY_THRESHOLDS
    s = col(score)
    return (F.when(s >= t["critical"], "critical").when(s >= t["high"], "high")
            .when(s >= t["medium"], "medium").when(s >= t["low"], "low").otherwise("normal"))


def score_band(score: Column | str) -> Column:
    """Display band of a score."""
    s = col(score)
    return F.when(s >= 0.8, "danger").when(s >= 0.6, "warning").otherwise("info")
