"""Column functions over text: routes, addresses, redaction, snippets, CSV cells, identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as scripts know it, wider than that of \s.
SPACE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Longest address, and most query keys, that are looked at.
MAX_TARGET, MAX_KEYS = 2048, 100


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_route(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/"))


def route_to_openapi(path: Column, prefix: str = "") -> Column:
    """Parameters (a colon and a name, which has no digit first) in braces, below the prefix."""
    return normalize_route(F.concat(F.lit(prefix + "/"), F.regexp_replace(path, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")))


def repository_path(path: Column) -> Column:
    """A relative path without empty, ``.`` and ``..`` segments, ``.`` for the root itself; null if it is
    absolute or leaves the root."""
    kept = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    out = F.array_join(kept, "/")
    return F.when(F.regexp_like(path, F.lit(r"^(?:[/\\]|[A-Za-z]:)")) | F.regexp_like(out, F.lit(r"^\.\.(?:/|$)")), F.lit(None)).when(out == "", ".").otherwise(out)


def url_target(url: Column) -> Column:
    """Without fragment, query and user information (up to the last @ before the path); null, which is
    a dynamic target, if nothing is left or the address has over MAX_TARGET code points."""
    path = F.regexp_extract(url, r"^[^#?]*", 0)
    bare = F.when(F.contains(path, F.lit("://")), F.regexp_replace(path, r"(?s)^((?>.*?://))[^/]*@", "$1")).otherwise(F.regexp_replace(path, r"^(//)[^/]*@", "$1"))
    return F.when((F.length(url) <= MAX_TARGET) & (bare != ""), bare)


def url_query_keys(url: Column) -> Column:
    """Sorted distinct names among the query's first MAX_KEYS keys, without values; keys with braces
    are dropped first."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda s: F.regexp_extract(s, r"^[^=]*", 0))
    first = F.slice(F.filter(keys, lambda k: (k != "") & ~F.regexp_like(k, F.lit(r"[{}]"))), 1, MAX_KEYS)
    return F.when(F.length(url) <= MAX_TARGET, F.array_join(F.array_sort(F.array_distinct(first)), ",")).otherwise(F.lit(""))


def is_absolute(url: Column) -> Column:
    return F.regexp_like(url, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))


def joined_target(base: Column, base_kind: Column, request: Column, request_kind: Column) -> Column:
    """struct<value, kind> of a request under a base address; a null value is dynamic, a null kind of
    the base says that there is none. An absolute request wins; a dynamic part makes the whole dynamic;
    the less exact kind (symbolic, then template, then exact) holds."""
    either = lambda k: (base_kind == k) | (request_kind == k)
    value = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(request, "^/+", ""))
    alone = F.coalesce(is_absolute(request), F.lit(False)) | base_kind.isNull()
    fits = base.isNotNull() & request.isNotNull() & (F.length(value) <= MAX_TARGET)
    kind = F.when(alone, request_kind).when(~fits, "dynamic").when(either("symbolic"), "symbolic").when(either("template"), "template").otherwise("exact")
    return F.struct(F.when(alone, request).when(fits, value).alias("value"), kind.alias("kind"))


#: Fixed names of what is secret, and the quotes around values.
SECRET_NAMES = r"(?:api[_-]?key|secret|password|passwd|token|authorization)"
_QUOTED = r"""(["'`])[^\r\n]*?\2"""
#: Fixed rules, in this order: what is matched, what it becomes.
REDACTIONS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (rf"(?i)(\b[a-z][a-z0-9+.-]*://(?:(?!{SPACE})[^/:@])+:)(?:(?!{SPACE})[^@/])+(@)", "$1[REDACTED]$2"),
    (rf"(?i)\bBearer{SPACE}+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (rf"(?i)(\b{SECRET_NAMES}\b{SPACE}*[=!]==?{SPACE}*){_QUOTED}", "$1$2[REDACTED]$2"),
    (rf"(?i)(\b{SECRET_NAMES}\b{SPACE}*[:=]{SPACE}*){_QUOTED}", "$1$2[REDACTED]$2"),
)


def redact(text: Column) -> Column:
    for pattern, into in REDACTIONS:
        text = F.regexp_replace(text, pattern, into)
    return text


def snippet(text: Column, limit: int) -> Column:
    """Trimmed, redacted, then cut to limit code points, the last an ellipsis if any are lost."""
    t = redact(trim(text))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def signature(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def utf16_length(text: Column) -> Column:
    """How many UTF-16 units a text has: two for a character beyond U+FFFF."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def line_and_column(text: Column, offset: Column) -> Column:
    """struct<line, column>, both from 1, of a place before which the text has ``offset`` code points;
    columns count UTF-16 units. Null outside the text."""
    before = F.substring(text, F.lit(1), offset)
    breaks = r"\r\n|[\r\n\u2028\u2029]"
    own = F.struct((F.regexp_count(before, F.lit(breaks)) + 1).alias("line"), (utf16_length(F.regexp_extract(before, rf"(?s)^(?:.*(?:{breaks}))?(.*)$", 1)) + 1).alias("column"))
    return F.when((offset >= 0) & (offset <= F.length(text)), own)


def trace_file_name(verb: Column, path: Column, endpoint: Column) -> Column:
    """verb-route-suffix.md: the route's ASCII letters and digits in lower case, 96 at most, with parameters named
    (:id is param-id; / alone is root, nothing left is route), and ten characters of the id."""
    named = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(F.startswith(s, F.lit(":")), F.concat(F.lit("param-"), F.substring(s, 2, 1 << 30))).otherwise(s))
    label = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.array_join(named, "-")), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 96)
    return F.concat(F.lower(verb), F.lit("-"), F.when(path == "/", "root").when(label == "", "route").otherwise(label), F.lit("-"), F.substring(F.element_at(F.split(endpoint, ":"), -1), 1, 10), F.lit(".md"))


def target_label(kind: Column, name: Column, detail: Column, technology: Column) -> Column:
    """What a target is called: an address with its verb, an event, a queue with its job, or a message."""
    or_ = lambda c, text: F.coalesce(c, F.lit(text))
    return (
        F.when(kind == "outbound_http", F.concat_ws(" ", technology, or_(name, "dynamic target")))
        .when(kind == "in_process_event", F.concat(F.when(detail == "symbol", "symbol ").otherwise(""), or_(name, "dynamic event")))
        .when(kind == "job_queue", F.concat(technology, F.lit(" queue "), or_(name, "dynamic queue"), F.lit("; job "), or_(detail, "any/dynamic job")))
        .when(kind == "microservice_message", F.concat(or_(name, "dynamic pattern"), F.lit("; client "), or_(detail, "dynamic client"), F.lit("; transport "), or_(technology, "unknown transport")))
    )


def resource_label(technology: Column, operation: Column, target: Column) -> Column:
    """What a resource access is called. target: struct<kind, value, token, segments: array<struct<kind, value, token, index>>>, of
    kind exact, symbolic, dynamic or template; a template's segments are literals, symbols or placeholders."""
    part = lambda s: F.when(s["kind"] == "literal", s["value"]).when(s["kind"] == "symbolic", F.concat(F.lit("${"), s["token"], F.lit("}"))).otherwise(F.concat(F.lit("${"), s["index"].cast("string"), F.lit("}")))
    kind = target["kind"]
    name = F.when(kind == "exact", target["value"]).when(kind == "symbolic", F.concat(F.lit("$"), target["token"])).when(kind == "dynamic", "<dynamic>").otherwise(F.array_join(F.transform(target["segments"], part), ""))
    return F.concat_ws(" ", technology, operation, name)


def target_dynamism(kind: Column, name: Column, detail: Column, technology: Column) -> Column:
    """static, dynamic or unknown, from the parts that identify a target of its kind."""
    needs = F.when(kind == "outbound_http", name.isNull() | (technology == "UNKNOWN")).when(kind == "in_process_event", name.isNull()).otherwise(name.isNull() | detail.isNull())
    return F.when(needs, "dynamic").when((kind == "microservice_message") & technology.isNull(), "unknown").otherwise("static")


def csv_cell(text: Column) -> Column:
    """Quoted where needed; a cell that a spreadsheet would take for a formula gets an apostrophe."""
    safe = F.when(F.regexp_like(text, F.lit(r"^[=+@-]")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(F.regexp_like(safe, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def json_string(value: Column) -> Column:
    """A string as JSON writes it; control characters as \\uXXXX unless they have a short form."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    full = out
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit("\\" + (short.get(code) or f"u{code:04x}")))
    quoted = F.when(F.regexp_like(value, F.lit(r"[\u0000-\u001F]")), full).otherwise(out)
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def json_value(value: Column) -> Column:
    """A string, number, boolean or null."""
    plain = F.typeof(value).isin("boolean", "tinyint", "smallint", "int", "bigint", "void")
    return F.coalesce(F.when(plain, value.cast("string")).otherwise(json_string(value.cast("string"))), F.lit("null"))


def semantic_key(kind: str, *parts: Column) -> Column:
    """A kind and its parts as a JSON array: the identity of a record across snapshots."""
    return F.concat(F.lit(f'["{kind}",'), F.concat_ws(",", *map(json_value, parts)), F.lit("]"))


def stable_id(kind: str, *parts: Column) -> Column:
    """The kind and 32 hexadecimal digits of a digest of the parts."""
    json = F.concat(F.lit("["), F.concat_ws(",", *map(json_value, parts)), F.lit("]"))
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(json, 256), 1, 32))
