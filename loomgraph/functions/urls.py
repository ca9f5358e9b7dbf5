"""URL keys and the public-address rule as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import let, strip
from loomgraph.schemas import TRACKING_PARAMS, TRACKING_PREFIX

# --- fixed values: the parts of a URL (RFC 3986, appendix B, scheme as in WHATWG) -----
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
SCHEME, HOST, PATH, QUERY = 1, 2, 3, 4
HIERARCHICAL_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss", "sftp", "nfs", "gopher", "rsync", "svn", "git")
# --- end of fixed values ----------------------------------------------------------


@lru_cache(maxsize=1)
def _folding_delimiters() -> str:
    """Characters whose compatibility form contains a URL delimiter; a host with one is malformed."""
    return "".join(
        chr(i)
        for i in range(0x80, 0x10000)
        if not 0xD800 <= i < 0xE000 and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(i)))
    )


def _clean(url: Column) -> Column:
    """Outer control characters and spaces off; line breaks and tabs out."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_clean(url), PARTS, group)


def _malformed(host: Column) -> Column:
    bracketed = host.contains("[") | host.contains("]")
    well_bracketed = host.rlike(r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|v[0-9A-Fa-f]+\..+)\](?::.*)?$")
    return (bracketed & ~well_bracketed) | host.rlike(f"[{_folding_delimiters()}]")


def _decode(c: Column) -> Column:
    lone_percent_kept = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(lone_percent_kept)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(p.contains("="), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    wanted = F.filter(
        pairs,
        lambda p: ~F.lower(p.k).startswith(TRACKING_PREFIX) & ~F.lower(p.k).isin(*TRACKING_PARAMS),
    )
    return F.array_join(
        F.transform(F.array_sort(wanted), lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&"
    )


def _parts(url: Column) -> Column:
    names = ((SCHEME, "scheme"), (HOST, "host"), (PATH, "path"), (QUERY, "query"))
    return let(_clean(url), lambda u: F.struct(*(F.regexp_extract(u, PARTS, i).alias(n) for i, n in names)))


def canonical_url(url: Column) -> Column:
    """One spelling per page: no fragment, no tracking parameters, sorted query, no trailing
    slash, lower-case scheme and host. A malformed URL only matches itself."""

    def spell(p: Column) -> Column:
        shorter = F.regexp_replace(p.path, "/+$", "")
        return let(
            F.struct(
                F.lower(p.scheme).alias("scheme"),
                F.lower(p.host).alias("host"),
                F.when(shorter == "", p.path).otherwise(shorter).alias("path"),
                _sorted_query(p["query"]).alias("query"),
            ),
            join,
        )

    def join(p: Column) -> Column:
        rooted = (p.path == "") | p.path.startswith("/")
        slashed = (p.host != "") | (p.scheme.isin(*HIERARCHICAL_SCHEMES) & rooted) | p.path.startswith("//")
        return F.concat(
            F.when(p.scheme != "", F.concat(p.scheme, F.lit(":"))).otherwise(""),
            F.when(slashed, F.concat(F.lit("//"), p.host)).otherwise(""),
            F.when((p.host != "") & ~rooted, F.lit("/")).otherwise(""),
            p.path,
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
        )

    return let(_parts(url), lambda p: F.when(_malformed(p.host), strip(url)).otherwise(spell(p)))


def is_web_url(value: Column) -> Column:
    """An http(s) URL without embedded markup."""
    scheme = F.lower(_part(value, SCHEME))
    return F.coalesce(
        scheme.isin("http", "https") & ~value.contains("<") & ~F.lower(value).contains("%3c"), F.lit(False)
    )


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null when there is none."""
    authority = F.regexp_replace(_part(url, HOST), r"(?s)^.*@", "")
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(authority, r":.*$", "")
    )
    return F.nullif(F.lower(host), F.lit(""))


# --- fixed values: addresses that are not public (IANA special-purpose registries) -------
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
PRIVATE_V4_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
# IPv6 is public inside this block only, and there not in the next ones, except for the last ones.
GLOBAL_V6 = "2000::/3"
PRIVATE_V6 = ("2001::/23", "2001:db8::/32", "2002::/16")
PRIVATE_V6_EXCEPT = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
# --- end of fixed values ----------------------------------------------------------


@lru_cache(maxsize=1)
def _folding_delimiters() -> str:
    """Characters whose compatibility form contains a URL delimiter; a host with one is malformed."""
    return "".join(
        chr(i)
        for i in range(0x80, 0x10000)
        if not 0xD800 <= i < 0xE000 and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(i)))
    )


def _clean(url: Column) -> Column:
    """Outer control characters and spaces off; line breaks and tabs out."""
    return F.regexp_replace(F.regexp_replace(strip(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_clean(url), PARTS, group)


def _malformed(host: Column) -> Column:
    bracketed = host.contains("[") | host.contains("]")
    well_bracketed = host.rlike(r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|v[0-9A-Fa-f]+\..+)\](?::.*)?$")
    return (bracketed & ~well_bracketed) | host.rlike(f"[{_folding_delimiters()}]")


def _decode(c: Column) -> Column:
    lone_percent_kept = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(lone_percent_kept)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(p.contains("="), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    wanted = F.filter(
        pairs,
        lambda p: ~F.lower(p.k).startswith(TRACKING_PREFIX) & ~F.lower(p.k).isin(*TRACKING_PARAMS),
    )
    return F.array_join(
        F.transform(F.array_sort(wanted), lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&"
    )


def _parts(url: Column) -> Column:
    names = ((SCHEME, "scheme"), (HOST, "host"), (PATH, "path"), (QUERY, "query"))
    return let(_clean(url), lambda u: F.struct(*(F.regexp_extract(u, PARTS, i).alias(n) for i, n in names)))


def canonical_url(url: Column) -> Column:
    """One spelling per page: no fragment, no tracking parameters, sorted query, no trailing
    slash, lower-case scheme and host. A malformed URL only matches itself."""

    def spell(p: Column) -> Column:
        shorter = F.regexp_replace(p.path, "/+$", "")
        return let(
            F.struct(
                F.lower(p.scheme).alias("scheme"),
                F.lower(p.host).alias("host"),
                F.when(shorter == "", p.path).otherwise(shorter).alias("path"),
                _sorted_query(p["query"]).alias("query"),
            ),
            join,
        )

    def join(p: Column) -> Column:
        rooted = (p.path == "") | p.path.startswith("/")
        slashed = (p.host != "") | (p.scheme.isin(*HIERARCHICAL_SCHEMES) & rooted) | p.path.startswith("//")
        return F.concat(
            F.when(p.scheme != "", F.concat(p.scheme, F.lit(":"))).otherwise(""),
            F.when(slashed, F.concat(F.lit("//"), p.host)).otherwise(""),
            F.when((p.host != "") & ~rooted, F.lit("/")).otherwise(""),
            p.path,
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
        )

    return let(_parts(url), lambda p: F.when(_malformed(p.host), strip(url)).otherwise(spell(p)))


def is_web_url(value: Column) -> Column:
    """An http(s) URL without embedded markup."""
    scheme = F.lower(_part(value, SCHEME))
    return F.coalesce(
        scheme.isin("http", "https") & ~value.contains("<") & ~F.lower(value).contains("%3c"), F.lit(False)
    )


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null when there is none."""
    authority = F.regexp_replace(_part(url, HOST), r"(?s)^.*@", "")
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(authority, r":.*$", "")
    )
    return F.nullif(F.lower(host), F.lit(""))


# --- fixed values: addresses that are not public (IANA special-purpose registries) -------
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
PRIVATE_V4_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6_PATTERN = (
    r"^(?:::|::1|(?:64:ff9b:1|100:0*:0*:0*|100:):.*|2001:(?:0{0,3}[0-9a-f]?|1[0-9a-f]{2}|0?[0-9a-f]{2}):.*|2001:0?db8:.*"
    r"|2002:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|0?[0-9a-f]{0,3}::?.*)$"
)
# --- end of fixed values ----------------------------------------------------------


def _v4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, o: n * 256 + o.cast("bigint"))


def _in_block(number: Column, block: str) -> Column:
    base, bits = block.split("/")
    low = 0
    for octet in base.split("."):
        low = low * 256 + int(octet)
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


def _v6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, null for anything else."""
    # A trailing IPv4 part is two groups more.
    tail = F.regexp_extract(ip, r"^(?:.*:)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("bigint"))), 2, "0"))
    spelled = F.when(
        tail != "", F.concat(F.regexp_replace(ip, r"[0-9.]+$", ""), F.array_join(F.slice(octets, 1, 2), ""), F.lit(":"), F.array_join(F.slice(octets, 3, 2), ""))
    ).otherwise(ip)
    halves = F.split(spelled, "::", -1)

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")

    head, rest = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    missing = F.lit(8) - F.size(head) - F.size(rest)
    whole = F.concat(head, F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), rest)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    one_gap = ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing > 0))
    return F.when(one_gap & spelled.rlike(r"^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}$") & ~spelled.rlike(r":::|^:[^:]|[^:]:$") & (F.length(digits) == 32), digits)


def _in_v6_block(digits: Column, block: str) -> Column:
    """Hex digits of one length compare like the numbers they spell."""
    network = ip_network(block)
    low = int(network.network_address)
    return digits.between(f"{low:032x}", f"{low + network.num_addresses - 1:032x}")


def is_public_ip(ip: Column) -> Column:
    """False for private, loopback, link-local, multicast, reserved and unspecified addresses, and for what is no address."""
    is_v4 = ip.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    number = _v4_number(F.when(is_v4, ip))
    private = F.lit(False)
    for block in PRIVATE_V4:
        private = private | _in_block(number, block)
    for block in PRIVATE_V4_EXCEPT:
        private = private & ~_in_block(number, block)

    def public_v6(digits: Column) -> Column:
        hidden = F.lit(False)
        for block in PRIVATE_V6:
            hidden = hidden | _in_v6_block(digits, block)
        for block in PRIVATE_V6_EXCEPT:
            hidden = hidden & ~_in_v6_block(digits, block)
        return F.coalesce(_in_v6_block(digits, GLOBAL_V6) & ~hidden, F.lit(False))

    return F.when(is_v4, ~private).otherwise(let(_v6_digits(F.lower(ip)), public_v6))
