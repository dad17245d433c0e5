"""Parsing and normalization of raw log lines.

Parsing stays in Catalyst expressions: one projection cuts a line into the groups of its layout with a single
regex pass (null when the line has another layout), a second one turns the groups into typed columns.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden.functions import values as v
from logwarden.schemas import SILVER_FIELDS
from logwarden.sources.files import EVENT_XML

log = logging.getLogger(__name__)

# Line layouts.
SYSLOG_TIME = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
SYSLOG_HOST = r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:"
SYSLOG_TEXT = r":\s+(.+)$"
RFC3164 = (r"(?s)^<(\d+)>(?:\d+ )?(?:(\w{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2})|"
           r"(\d{4}-\d{2}-\d{2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)) (\S+) (\S+): (.*)")
RFC5424 = (r"(?s)^<(\d+)>(\d+) (\d{4}-\d{2}-\d{2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?) "
           r"(\S+) (\S+) (\S+) (\S+) (\[.*?\]|-)? ?(.*)")
PROCESS_PID = r"^([^\[]+)(?:\[(\d+)\])?"
CEF = (r"(?s)^.*?CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^\n]*).*$")
CEF_PAIR = r"([a-zA-Z0-9_]+)=([^=]+(?:(?<=\\)=[^=]*)*)(?:\s|$)"
CLF = r'^(\S+) (\S+) (\S+) \[(.*?)\] "([^"]*)" (\d+) (\S+)(?: "([^"]*)" "([^"]*)")?(?s:.*)$'
CLF_TIME = "dd/MMM/yyyy:HH:mm:ss Z"

# Names of CEF extension keys, web-server JSON keys and Windows fields.
CEF_NAMES = {
    "src": "source_ip",
    "dst": "dest_ip",
    "spt": "source_port",
    "dpt": "dest_port",
    "proto": "protocol",
    "act": "action",
    "outcome": "status",
    "dhost": "dest_hostname",
    "shost": "source_hostname",
    "duser": "dest_user",
    "suser": "source_user",
    "app": "application",
    "deviceDirection": "direction",
    "cat": "category",
    "reason": "reason",
    "request": "url",
    "requestMethod": "method",
    "cs1": "signature",
    "cs2": "rule_name",
    "cn1": "duration",
}
NGINX_NAMES = {
    "remote_addr": "source_ip",
    "remote_user": "user",
    "time_local": "timestamp",
    "request": "request",
    "status": "status_code",
    "body_bytes_sent": "bytes_out",
    "http_referer": "referer",
    "http_user_agent": "user_agent",
    "request_time": "duration",
    "request_method": "method",
    "host": "host",
}
WINDOWS_NAMES = {
    "EventID": "event_id",
    "Computer": "hostname",
    "Provider_Name": "provider",
    "Channel": "log_channel",
    "Keywords": "keywords",
    "Level": "level",
    "TimeCreated_SystemTime": "timestamp",
    "EventRecordID": "record_id",
    "Security_UserID": "user_sid",
    "Execution_ProcessID": "process_id",
    "Execution_ThreadID": "thread_id",
    "EventData": "event_data",
}
WINDOWS_USER_KEYS = ["TargetUserName", "SubjectUserName", "UserName", "User"]
WINDOWS_IP_KEYS = ["IpAddress", "ClientAddress", "ClientIP", "SourceAddress"]
# Candidate names of the detection-side schema.
IP_NAMES = ["source_ip", "dest_ip", "ip", "client_ip", "server_ip"]
USER_NAMES = ["username", "user", "account", "user_id", "uid"]
TIME_NAMES = ["timestamp", "time", "date", "datetime", "event_time"]


_CUT = "\u0001\u0002"


def groups_of(text: Column, pattern: str) -> Column:
    """All groups of a whole-line pattern as an array from one regex pass; null when it does not match."""
    n = re.compile(pattern).groups
    cut = F.regexp_replace(text, F.lit(pattern), F.lit(_CUT.join(f"${i + 1}" for i in range(n))))
    return F.when(text.rlike(pattern), F.split(cut, _CUT, n))


def at_group(parts: Column, i: int) -> Column:
    """Group ``i`` (from 1), null when it did not take part."""
    return v.empty_to_null(F.get(parts, F.lit(i - 1)))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator, so later filters and projections reuse the values.

    Through a plain projection Catalyst would copy the regexes into every predicate and field that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_lines(df: DataFrame, column: str, parts, fields) -> DataFrame:
    """Keep the lines with parts and add their fields."""
    out = once(df, {"_parts": parts(F.col(column))}).filter("_parts is not null")
    return out.withColumns(fields(F.col("_parts"), F.col(column))).drop("_parts")


# P05, P06
def number_text(seconds: Column) -> Column:
    """Epoch seconds as decimal text with at least one and at most six decimals."""
    micros = F.round(seconds * F.lit(1e6)).cast("bigint")
    part = F.regexp_replace(F.lpad(F.pmod(micros, F.lit(1000000)).cast("string"), 6, "0"), "0+$", "")
    return F.concat(F.floor(micros / 1000000).cast("string"), F.lit("."),
                    F.when(part == "", F.lit("0")).otherwise(part))


def with_event_id(df: DataFrame, name: str = "event_key") -> DataFrame:
    """Id from time and content; an existing ``id`` column wins where set."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    t = F.col("timestamp").cast("double")
    body = F.concat_ws("|", number_text(t), *[text(c) for c in ("source_ip", "username", "action", "message")])
    made = F.concat(F.lit("evt_"), F.floor(t).cast("string"), F.lit("_"), F.substring(F.md5(body), 1, 8))
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(own, made))


def with_log_id(df: DataFrame, name: str = "_id") -> DataFrame:
    """Id from all columns in name order; depends on the content only."""
    own = F.col(name) if name in df.columns else F.lit(None).cast("string")
    content = F.to_json(F.struct(*sorted(c for c in df.columns if c != name)))
    return df.withColumn(name, F.coalesce(own, F.concat(F.lit("log_"), F.md5(content))))


# P07
def java_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with (?P<name>...) groups as (plain pattern, group number per name)."""
    return re.sub(r"\(\?P<\w+>", "(", pattern), dict(re.compile(pattern).groupindex)


def regex_cells(text: Column, patterns: list[str], mapping: dict[str, str] | None = None,
                types: dict[str, str] | None = None) -> tuple[dict[str, Column], Column]:
    """Fields of the first matching pattern, and whether one matches; patterns that do not compile are skipped."""
    mapping, kinds = mapping or {}, {**{k: _kind(t) for k, t in SILVER_FIELDS.items()}, **(types or {})}
    plans = []
    for pattern in patterns:
        try:
            plain, groups = java_groups(pattern)
        except re.error as e:
            log.warning("pattern %r skipped: %s", pattern, e)
            continue
        plans.append((text.rlike(plain), {mapping.get(n, n): v.group(text, plain, i) for n, i in groups.items()}))
    out = {}
    for target in dict.fromkeys(t for _, cells in plans for t in cells):
        c = F
        for hit, cells in plans:
            c = c.when(hit, cells.get(target, F.lit(None).cast("string")))
        c = c.otherwise(None)
        out[target] = v.cast_lenient(c, kinds[target]) if target in kinds else c
    for ip in ("source_ip", "dest_ip"):
        if ip in out:
            out[ip] = F.coalesce(v.valid_ip(out[ip]), out[ip])
    flag = F.lit(False)
    for hit, _ in plans:
        flag = flag | hit
    return out, flag


def normalize_regex(df: DataFrame, patterns: list[str], mapping: dict[str, str] | None = None,
                    types: dict[str, str] | None = None, column: str = "message") -> DataFrame:
    """The first matching pattern fills the mapped, typed fields; ``_normalized`` says whether one matched."""
    cells, flag = regex_cells(F.col(column), patterns, mapping, types)
    return df.withColumns({**cells, "_normalized": flag})


def _kind(t: str) -> str:
    return {"bigint": "int", "double": "float", "string": "str"}[t]


# P08, P09
def parse_syslog(df: DataFrame, column: str = "message_raw") -> DataFrame:
    """Time text, host, process, pid and message of a BSD syslog line."""
    c = F.col(column)
    return df.withColumns({
        "timestamp_raw": v.group(c, SYSLOG_TIME, 1),
        "hostname": v.group(c, SYSLOG_HOST, 1),
        "process": v.group(c, SYSLOG_HOST, 2),
        "pid": v.group(c, SYSLOG_HOST, 3),
        "message": v.group(c, SYSLOG_TEXT, 1),
    })


def classify_auth(df: DataFrame, column: str = "message") -> DataFrame:
    """Event type, user and address of authentication messages; cheap text tests guard the regexes."""
    m = F.col(column)
    failed, accepted = m.contains("Failed password"), m.contains("Accepted password") | m.contains("Accepted publickey")
    closed = m.contains("Connection closed")
    login = failed | accepted
    return df.withColumns({
        "event_type": F.when(failed, "auth_failure").when(accepted, "auth_success").when(closed, "connection_closed"),
        "username": F.when(login, v.group(m, r"for\s+(\S+)", 1)),
        "source_ip": F.when(login, v.group(m, r"from\s+(\d+\.\d+\.\d+\.\d+)", 1))
        .when(closed, v.group(m, r"by\s+(\d+\.\d+\.\d+\.\d+)", 1)),
    })


# P10-P14
def decode_pri(df: DataFrame, column: str = "pri") -> DataFrame:
    """P10."""
    p = F.col(column).cast("int")
    return df.withColumns({"facility": v.facility(p), "severity": v.severity_name(p)})


def ips_of(text: Column) -> Column:
    """Valid IPv4 addresses of a text in order."""
    return F.filter(F.regexp_extract_all(text, F.lit("(" + v.IPV4_IN_TEXT + ")"), 1), lambda x: x.rlike(v.IPV4))


def extract_ips(df: DataFrame, column: str = "message") -> DataFrame:
    """First address as source_ip, second as dest_ip."""
    out = df.withColumn("_ips", ips_of(F.col(column)))
    return out.withColumns({"source_ip": F.get("_ips", F.lit(0)), "dest_ip": F.get("_ips", F.lit(1))}).drop("_ips")


def rfc5424_parts(text: Column) -> Column:
    return F.when(text.startswith("<"), groups_of(text, RFC5424))


def rfc5424_fields(parts: Column, text: Column) -> dict[str, Column]:
    g = lambda i: at_group(parts, i)
    pri, ips, app = g(1).cast("int"), ips_of(text), v.dash_to_null(g(5))
    return {
        "timestamp": v.epoch_seconds(g(3).try_cast("timestamp")), "hostname": g(4), "application": app,
        "process": v.dash_to_null(g(6)), "msg_id": v.dash_to_null(g(7)), "structured_data": v.dash_to_null(g(8)),
        "message": F.coalesce(g(9), F.lit("")), "facility": v.facility(pri), "severity": v.severity_name(pri),
        "syslog_version": g(2), "source_ip": F.get(ips, F.lit(0)), "dest_ip": F.get(ips, F.lit(1)),
        "event_type": F.coalesce(v.event_type_from_process(g(6)), v.event_type_from_process(app)),
    }


def rfc3164_parts(text: Column) -> Column:
    return F.when(text.startswith("<"), groups_of(text, RFC3164))


def rfc3164_fields(year: int):
    """The line has no year, so it is an argument."""

    def fields(parts: Column, text: Column) -> dict[str, Column]:
        g = lambda i: at_group(parts, i)
        pri, tag, ips = g(1).cast("int"), g(5), ips_of(text)
        named = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(g(2), r"\s+", " ")),
                                   F.lit("yyyy MMM d H:m:s"))
        process = F.coalesce(v.group(tag, PROCESS_PID, 1), tag)
        return {
            "timestamp": v.epoch_seconds(F.coalesce(named, g(3).try_cast("timestamp"))), "hostname": g(4),
            "process": process, "pid": v.group(tag, PROCESS_PID, 2), "message": F.coalesce(g(6), F.lit("")),
            "facility": v.facility(pri), "severity": v.severity_name(pri), "source_ip": F.get(ips, F.lit(0)),
            "dest_ip": F.get(ips, F.lit(1)), "event_type": v.event_type_from_process(process),
        }

    return fields


def normalize_rfc5424(df: DataFrame, column: str = "message") -> DataFrame:
    """Only lines of this layout."""
    return parse_lines(df, column, rfc5424_parts, rfc5424_fields)


def normalize_rfc3164(df: DataFrame, year: int, column: str = "message") -> DataFrame:
    """Only lines of this layout."""
    return parse_lines(df, column, rfc3164_parts, rfc3164_fields(year))


def event_type_from_process(df: DataFrame, column: str = "process") -> DataFrame:
    """P14."""
    return df.withColumn("event_type", v.event_type_from_process(column))


# P15, P16
def flatten(df: DataFrame, sep: str = ".", keep: list[str] | None = None) -> DataFrame:
    """Nested struct fields as top-level columns named by their path; listed paths stay whole."""
    keep = keep or []

    def walk(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            here = path + [f.name]
            if isinstance(f.dataType, T.StructType) and sep.join(here) not in keep:
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema, []))


def json_map(text: Column) -> Column:
    """Top-level keys of a JSON object (nested values stay JSON text) from one parse; null for other text."""
    return F.when(text.startswith("{"), F.from_json(text, "map<string,string>"))


def json_value(keys: Column, path: str) -> Column:
    top, _, rest = path.partition(".")
    c = F.try_element_at(keys, F.lit(top))
    return F.get_json_object(c, "$." + rest) if rest else c


def any_time(c: Column) -> Column:
    """Epoch seconds from a number (s or ms) or a time text."""
    n = c.try_cast("double")
    return F.coalesce(F.when(n > 1e12, n / 1000).otherwise(n), v.epoch_seconds(v.parse_ts(c)))


def json_fields(keys: Column, mapping: dict[str, str], drops: list[str] | None, types: dict[str, str] | None,
                time_field: str = "timestamp") -> tuple[dict[str, Column], Column]:
    """Mapped, typed fields of a key map and the remaining keys as a map."""
    drops, kinds = drops or [], {**{k: _kind(t) for k, t in SILVER_FIELDS.items()}, **(types or {})}
    fields = {}
    for source, target in mapping.items():
        if target in drops:
            continue
        raw = json_value(keys, source)
        if target == time_field:
            fields["timestamp"] = any_time(raw)
        elif target in ("source_ip", "dest_ip"):
            fields[target] = F.coalesce(v.valid_ip(raw), raw)
        else:
            fields[target] = v.cast_lenient(raw, kinds[target]) if target in kinds else raw
    used = list(mapping) + drops
    rest = F.map_filter(keys, lambda k, _: ~k.isin(used) & ~k.startswith("_"))
    return fields, rest


def normalize_json(df: DataFrame, mapping: dict[str, str], drops: list[str] | None = None,
                   types: dict[str, str] | None = None, column: str = "message") -> DataFrame:
    """Rename, drop, type and time-parse the keys of a JSON line; other keys go to ``extra``."""
    fields, rest = json_fields(F.col("_keys"), mapping, drops, types)
    out = once(df, {"_keys": json_map(F.col(column))})
    return out.withColumns({**fields, "extra": rest, "_normalized": F.col("_keys").isNotNull()}).drop("_keys")


# P17-P19
def cef_parts(text: Column) -> Column:
    return F.when(text.contains("CEF:"), groups_of(text, CEF))


CEF_HEADER = ["cef_version", "vendor", "product", "device_version", "signature_id", "event_name", "severity", "extensions"]


def cef_fields(parts: Column, text: Column) -> dict[str, Column]:
    return {**{n: F.get(parts, F.lit(i)) for i, n in enumerate(CEF_HEADER)}, "event_type": F.lit("security")}


def parse_cef(df: DataFrame, column: str = "message") -> DataFrame:
    """Only CEF lines."""
    return parse_lines(df, column, cef_parts, cef_fields)


def cef_pairs(ext: Column) -> Column:
    """Extension pairs as a map under their standard names; escapes undone, the last duplicate wins."""
    # One regex pass cuts the pairs; a key has no '=', so the first one ends it. The match's last white space is no value.
    cut = F.regexp_extract_all(ext, F.lit(CEF_PAIR), 0)
    keys = F.transform(cut, lambda p: F.substring_index(p, "=", 1))

    def value(p: Column, k: Column) -> Column:
        end = F.ascii(F.substring(p, -1, 1)).isin(9, 10, 11, 12, 13, 32).cast("int")
        return F.substring(p, F.length(k) + 2, F.length(p) - F.length(k) - 1 - end)

    raw = F.map_from_arrays(keys, F.zip_with(cut, keys, value))
    plain = F.transform_values(raw, lambda _, x: F.replace(F.replace(F.replace(
        x, F.lit("\\="), F.lit("=")), F.lit("\\\\"), F.lit("\\")), F.lit("\\|"), F.lit("|")))
    return F.transform_keys(plain, lambda k, _: F.coalesce(v.labels(CEF_NAMES, k), k))


def cef_extensions(df: DataFrame, column: str = "extensions") -> DataFrame:
    """P18."""
    return df.withColumn("fields", cef_pairs(F.col(column)))


def standard_action(c: Column) -> Column:
    """Allow, deny and alert synonyms; other actions stay as they are."""
    a = F.lower(c)
    return (F.when(a.isin("allow", "permitted", "accept"), "allow").when(a.isin("block", "deny", "dropped"), "deny")
            .when(a.isin("alert", "warned"), "alert").otherwise(c))


def standardize_cef(df: DataFrame, column: str = "fields") -> DataFrame:
    """Typed standard columns from the extension map."""
    at = lambda k: F.try_element_at(column, F.lit(k))
    ip = lambda k: F.coalesce(v.valid_ip(at(k)), at(k))
    return df.withColumns({
        "timestamp": F.coalesce(*[any_time(at(k)) for k in ("rt", "end", "start")]),
        "source_ip": ip("source_ip"), "dest_ip": ip("dest_ip"),
        "source_port": v.cast_lenient(at("source_port"), "int"), "dest_port": v.cast_lenient(at("dest_port"), "int"),
        "user": F.coalesce(at("user"), at("source_user")), "action": standard_action(at("action")),
    })


# P20, P21
def clf_parts(text: Column) -> Column:
    return groups_of(text, CLF)


def clf_fields(parts: Column, text: Column) -> dict[str, Column]:
    g = lambda i: at_group(parts, i)
    code, when = g(6).try_cast("int"), F.try_to_timestamp(g(4), F.lit(CLF_TIME))
    request, ua = v.parse_request(F.coalesce(g(5), F.lit(""))), v.dash_to_null(g(9))
    agent = v.parse_ua(ua)
    return {
        "source_ip": F.coalesce(v.valid_ip(g(1)), g(1)), "user": v.dash_to_null(g(3)),
        "timestamp": v.epoch_seconds(F.coalesce(when, v.parse_ts(g(4)))), "status_code": code.cast("bigint"),
        "bytes_out": F.coalesce(g(7).try_cast("bigint"), F.lit(0)), "request": g(5), "method": request["method"],
        "path": request["path"], "protocol": request["protocol"], "referer": v.dash_to_null(g(8)), "user_agent": ua,
        "browser": F.when(ua.isNotNull(), agent["browser"]), "os": F.when(ua.isNotNull(), agent["os"]),
        "is_mobile": F.when(ua.isNotNull(), agent["is_mobile"]), "status": v.status_class(code),
        "event_type": F.lit("web_access"),
    }


def parse_weblog(df: DataFrame, column: str = "message") -> DataFrame:
    """P20: only web log lines."""
    return parse_lines(df, column, clf_parts, clf_fields)


def nginx_parts(text: Column) -> Column:
    j = F.from_json(text, "struct<" + ",".join(f"{k}:string" for k in NGINX_NAMES) + ">")
    return F.when(text.startswith("{"), F.when(j["remote_addr"].isNotNull() | j["request"].isNotNull(), j))


def nginx_fields(parts: Column, text: Column) -> dict[str, Column]:
    at = {target: parts[source] for source, target in NGINX_NAMES.items()}
    request = v.parse_request(at["request"])
    when = F.try_to_timestamp(at["timestamp"], F.lit(CLF_TIME))
    code, agent = at["status_code"].try_cast("int"), v.parse_ua(at["user_agent"])
    known = at["user_agent"].isNotNull()
    return {
        "source_ip": F.coalesce(v.valid_ip(at["source_ip"]), at["source_ip"]), "user": at["user"],
        "timestamp": v.epoch_seconds(F.coalesce(when, v.parse_ts(at["timestamp"]))), "request": at["request"],
        "method": F.coalesce(at["method"], request["method"]), "path": F.when(at["method"].isNull(), request["path"]),
        "protocol": F.when(at["method"].isNull(), request["protocol"]), "status_code": code.cast("bigint"),
        "bytes_out": at["bytes_out"].try_cast("bigint"), "referer": at["referer"], "user_agent": at["user_agent"],
        "duration": at["duration"].try_cast("double"), "host": at["host"], "status": v.status_class(code),
        "browser": F.when(known, agent["browser"]), "os": F.when(known, agent["os"]),
        "is_mobile": F.when(known, agent["is_mobile"]),
    }


def parse_nginx(df: DataFrame, column: str = "message") -> DataFrame:
    """Only JSON access-log lines."""
    return parse_lines(df, column, nginx_parts, nginx_fields)


# P25, P28-P30
def normalize_windows(df: DataFrame, drops: list[str] | None = None, data: str = "event_data") -> DataFrame:
    """Rename the twelve fields, pass the rest through, label level and event id, pick user and address."""
    out = df.withColumnsRenamed({k: n for k, n in WINDOWS_NAMES.items() if k in df.columns}).drop(*(drops or []))
    cols = out.columns
    add = {}
    if "level" in cols:
        add["severity"] = v.windows_severity("level")
    if "event_id" in cols:
        add["event_type"] = v.security_event("event_id")
        add["category"] = F.when(v.security_event("event_id").isNotNull(), "security")
    if "timestamp" in cols:
        add["timestamp"] = v.epoch_seconds(v.parse_ts("timestamp"))
    if data in cols:
        if "user" not in cols:
            add["user"] = first_present(data, WINDOWS_USER_KEYS)
        if "source_ip" not in cols:
            add["source_ip"] = v.valid_ip(first_present(data, WINDOWS_IP_KEYS))
    return out.withColumns(add)


def first_present(map_column: str, names: list[str]) -> Column:
    """Value of the first listed key that a map holds."""
    return F.coalesce(*[F.try_element_at(map_column, F.lit(n)) for n in names])


def by_candidates(df: DataFrame, names: list[str], prefix: str = "", exclude: list[str] | None = None) -> Column:
    """First non-null of the prefixed candidate columns, then of the plain ones."""
    wanted = ([prefix + n for n in names] if prefix else []) + [n for n in names if n not in (exclude or [])]
    there = [F.col(c) for c in wanted if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def to_mini_schema(df: DataFrame, compat: bool = False) -> DataFrame:
    """Timestamp, source_ip, dest_ip and username from whatever candidate columns exist.

    ``compat`` lets dest_ip fall back to a source address.
    """
    stamp = F.coalesce(*[any_time(F.col(c).cast("string")) for c in TIME_NAMES if c in df.columns])
    skip = [] if compat else ["source_ip", "ip", "client_ip"]
    return df.withColumns({
        "timestamp": stamp,
        "source_ip": by_candidates(df, IP_NAMES, "source_", ["dest_ip", "server_ip"]),
        "dest_ip": by_candidates(df, IP_NAMES, "dest_", skip),
        "username": by_candidates(df, USER_NAMES),
    })


def to_schema(df: DataFrame, mapping: dict[str, str], schema: list[str]) -> DataFrame:
    """Source -> target renames, then the remaining schema fields by name; absent ones are null."""
    by_target = {t: s for s, t in mapping.items() if s in df.columns}
    pick = lambda f: F.col(by_target[f]) if f in by_target else F.col(f) if f in df.columns else F.lit(None).cast("string")
    return df.select(*[pick(f).alias(f) for f in schema])


# P31
ORDER = ["rfc5424", "rfc3164", "cef", "windows", "weblog", "nginx", "regex", "json"]


def windows_parts(text: Column) -> Column:
    plain = F.regexp_replace(text, r'\sxmlns="[^"]*"|\sxmlns=\'[^\']*\'', "")
    return F.when(text.startswith("<Event"), F.from_xml(plain, EVENT_XML, {"mode": "PERMISSIVE"}))


def windows_fields(event: Column, pairs: Column) -> dict[str, Column]:
    system = event["System"]
    first = lambda names: F.coalesce(*[F.try_element_at(pairs, F.lit(n)) for n in names])
    return {"timestamp": v.epoch_seconds(v.parse_ts(system["TimeCreated"]["_SystemTime"])), "hostname": system["Computer"],
            "severity": v.windows_severity(system["Level"]), "event_type": v.security_event(system["EventID"]),
            "user": first(WINDOWS_USER_KEYS), "source_ip": v.valid_ip(first(WINDOWS_IP_KEYS))}


def normalize_all(df: DataFrame, column: str = "message", *, year: int, json_mapping: dict[str, str] | None = None,
                  patterns: list[str] | None = None, regex_mapping: dict[str, str] | None = None,
                  order: list[str] | None = None) -> DataFrame:
    """The first layout in ``order`` that accepts a line normalizes it; adds the silver fields, _format, _normalized.

    Layouts: syslog (two), CEF, Windows event XML, web log, access-log JSON, the caller's ``patterns``, other JSON. First
    projection: the parts of each layout, each behind a cheap test; the web log's regex runs only where no layout with a
    marked beginning took the line. Second: the fields. Rows that come in with ``_normalized`` true keep what they have.
    Lines no layout accepts keep their raw text and nulls (``quarantine``).
    """
    order = order or ORDER
    unknown = set(order) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown layouts {sorted(unknown)}")
    came = df.columns
    done = F.coalesce(F.col("_normalized"), F.lit(False)) if "_normalized" in came else F.lit(False)
    prior = {c: F.col(f"_prior.{c}") for c in [*SILVER_FIELDS, "extra", "raw_message", "ts", "_format"] if c in came}
    base = df.withColumn("_done", done)
    if prior:
        base = base.withColumn("_prior", F.struct(*prior)).drop(*prior)
    m = F.when(~F.col("_done"), F.col(column))
    new, old, cef, win, web, nginx, keys = (F.col(c) for c in ("_new", "_old", "_cef", "_win", "_web", "_nginx", "_keys"))
    nothing = F.lit(None).cast("array<string>")
    cut = once(base, {"_new": rfc5424_parts(m), "_cef": cef_parts(m), "_win": windows_parts(m), "_nginx": nginx_parts(m), "_keys": json_map(m)})
    pairs = F.filter(F.coalesce(win["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                     lambda d: d["_Name"].isNotNull())
    marked = new.isNotNull() | cef.isNotNull() | win["System"].isNotNull() | keys.isNotNull()
    cut = once(cut, {"_old": F.when(new.isNull(), rfc3164_parts(m)), "_ext": cef_pairs(F.get(cef, F.lit(7))),
                     "_pairs": F.map_from_arrays(pairs["_Name"], pairs["_VALUE"])})
    regex, hit = regex_cells(m, patterns or [], regex_mapping)
    cut = once(cut, {"_web": F.when(~marked & old.isNull(), clf_parts(m)) if "weblog" in order else nothing,
                     "_regex": F.coalesce(hit, F.lit(False))})
    taken = {"rfc5424": new.isNotNull(), "rfc3164": old.isNotNull(), "cef": cef.isNotNull(), "windows": win["System"].isNotNull(),
             "weblog": web.isNotNull(), "nginx": nginx.isNotNull(), "regex": F.col("_regex"), "json": keys.isNotNull()}
    first = F
    for name in order:
        first = first.when(taken[name], name)
    cut = once(cut, {"_format": first.otherwise(None)})
    at = lambda k: F.try_element_at("_ext", F.lit(k))
    json_cells, rest = json_fields(keys, json_mapping or {n: n for n in SILVER_FIELDS}, None, None)
    ip = lambda c: F.coalesce(v.valid_ip(c), c)
    cef_cells = {
        "timestamp": F.coalesce(*[any_time(at(k)) for k in ("rt", "end", "start")]), "source_ip": ip(at("source_ip")),
        "dest_ip": ip(at("dest_ip")), "source_port": v.cast_lenient(at("source_port"), "int"),
        "dest_port": v.cast_lenient(at("dest_port"), "int"), "protocol": at("protocol"),
        "user": F.coalesce(at("user"), at("source_user")), "action": standard_action(at("action")),
        "status": at("status"), "severity": F.get(cef, F.lit(6)), "event_type": F.lit("security"),
        "duration": at("duration").try_cast("double"), "url": at("url"), "method": at("method"),
    }
    by_format = {"rfc5424": rfc5424_fields(new, m), "rfc3164": rfc3164_fields(year)(old, m), "cef": cef_cells,
                 "windows": windows_fields(win, F.col("_pairs")), "weblog": clf_fields(web, m), "nginx": nginx_fields(nginx, m),
                 "regex": regex, "json": json_cells}
    cells = {}
    for name, kind in SILVER_FIELDS.items():
        c = F.when(F.col("_done"), prior[name].cast(kind)) if name in prior else F
        for fmt in order:
            if name in by_format[fmt]:
                c = c.when(F.col("_format") == fmt, by_format[fmt][name].cast(kind))
        cells[name] = F.lit(None).cast(kind) if c is F else c
    cells["extra"] = (F.when(F.col("_done"), prior["extra"]) if "extra" in prior else F).when(F.col("_format") == "cef", F.col("_ext")).when(
        F.col("_format") == "json", rest).when(F.col("_format") == "windows", F.col("_pairs"))
    raw = F.when(F.col("_done"), prior["raw_message"]).otherwise(F.col(column)) if "raw_message" in prior else F.col(column)
    out = cut.withColumns({**cells, "raw_message": raw, "_normalized": F.col("_done") | F.col("_format").isNotNull()})
    if "_format" in prior:
        out = out.withColumn("_format", F.coalesce("_format", prior["_format"]))
    out = out.withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * F.lit(1e6)).cast("bigint")))
    return out.drop("_new", "_old", "_cef", "_win", "_web", "_nginx", "_keys", "_ext", "_pairs", "_regex", "_done", "_prior")


def quarantine(df: DataFrame) -> DataFrame:
    """Rows no parser accepted, or without a usable time."""
    return df.filter(~F.col("_normalized") | F.col("timestamp").isNull())


# P32, P34, P35. The indicator patterns.
IOC_PATTERNS = {
    "url": r"https?://[^\s\"'<>]+",
    "ip": v.IPV4_IN_TEXT,
    "hash": r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
}


#: What every match of a kind contains; a linear scan for it spares most texts the costly pattern.
IOC_TRACES = {"url": "://", "ip": r"[0-9]\.[0-9]", "hash": "[a-fA-F0-9]{32}", "domain": r"[a-zA-Z0-9]\.[a-zA-Z0-9]"}


def _tagged(text: Column, kind: str, pattern: str) -> Column:
    tagged = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1),
                         lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("indicator")))
    return F.when(text.rlike(IOC_TRACES[kind]), tagged).otherwise(F.array().cast("array<struct<kind:string,indicator:string>>"))


def extract_iocs(df: DataFrame, column: str) -> DataFrame:
    """(kind, indicator, occurrences) over all texts; counts are combined before the shuffle."""
    found = [_tagged(F.col(column), kind, p) for kind, p in IOC_PATTERNS.items()]
    rows = df.select(F.explode(F.concat(*found)).alias("i")).select("i.*")
    rows = rows.filter((F.col("kind") != "ip") | F.col("indicator").rlike(v.IPV4))
    return rows.groupBy("kind", "indicator").agg(F.count(F.lit(1)).alias("occurrences"))


def hash_files(spark, path: str) -> DataFrame:
    """SHA-256 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def redact(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Values of the listed keys of a map become a mask."""
    hidden = F.transform_values(column, lambda k, x: F.when(k.isin(keys), F.lit("***REDACTED***")).otherwise(x))
    return df.withColumn(column, hidden)
