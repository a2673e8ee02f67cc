"""Addresses, ports and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_num(address: Column) -> Column:
    """Address text as a number; null for anything but dotted IPv4."""
    part = F.split(address, r"\.")
    shifted = [F.shiftleft(part[i].cast("bigint"), 8 * (3 - i)) for i in range(4)]
    return F.when(address.rlike(_IPV4), shifted[0] + shifted[1] + shifted[2] + shifted[3])


def in_cidr(address: Column, cidr: str) -> Column:
    """Whether the address lies in the range; null when it is no IPv4 address."""
    base, bits = cidr.split("/")
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    spare = 32 - int(bits)
    return F.shiftright(ipv4_num(address), spare) == (number >> spare)


# The private ranges as one pattern, so that a row costs one match and no arithmetic.
_PRIVATE = r"10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\."

# Fixed form of IPv6: eight groups of hexadecimal digits; two colons stand for a run of zero
# groups; the last two groups may be written as IPv4; a zone may follow.
_GROUP, _V4 = r"[0-9a-f]{1,4}", _IPV4[1:-1]
_FULL6 = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_V4}"
_SHORT6 = (rf"(?=(?:[^:]*:){{2,7}}[^:]*$|::(?:[^:]+:){{6}}[^:]+$|(?:[^:]+:){{7}}:(?:%|$))"
           rf"(?:{_GROUP}(?::{_GROUP})*)?::(?:(?:{_GROUP}:)*(?:{_GROUP}|{_V4}))?")
_IPV6 = rf"(?i)^(?:{_FULL6}|{_SHORT6})(?:%[0-9a-z._~-]+)?$"
# Loopback, unspecified, link-local fe80::/10 and unique local fc00::/7; private IPv4 inside.
_LOCAL6 = (rf"(?i)^(?:::1?(?:%|$)|(?:0{{1,4}}:){{7}}0{{0,3}}[01](?:%|$)|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{{2}}:"
           rf"|::ffff:(?:{_PRIVATE}))")


def is_ipv6(address: Column) -> Column:
    return F.coalesce(address.rlike(_IPV6), F.lit(False))


def _local6(address: Column) -> Column:
    return is_ipv6(address) & address.rlike(_LOCAL6)


def is_private(address: Column) -> Column:
    """In one of the private ranges of IPv4, or local by IPv6; false for other text and for null."""
    return F.coalesce(address.rlike(rf"^(?={_PRIVATE}){_IPV4[1:]}"), F.lit(False)) | _local6(address)


def is_external(address: Column) -> Column:
    """An address outside the private and local ranges.

    Text that is no address is neither private nor external. Multicast counts as external; test
    it apart with ``is_multicast``.
    """
    return F.coalesce(address.rlike(rf"^(?!{_PRIVATE}){_IPV4[1:]}"), F.lit(False)) | (
        is_ipv6(address) & ~address.rlike(_LOCAL6))


def is_multicast(address: Column) -> Column:
    return F.coalesce(address.rlike(rf"^(?=22[4-9]\.|23\d\.){_IPV4[1:]}"), F.lit(False)) | (
        is_ipv6(address) & address.rlike("(?i)^ff[0-9a-f]{2}:"))


def address_kind(address: Column) -> Column:
    """private, external, or none for what is no address."""
    return F.when(is_private(address), "private").when(is_external(address), "external").otherwise("none")


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def subnet(address: Column) -> Column:
    """First three octets of an IPv4 address, first four groups of an IPv6 one, else null."""
    plain = F.lower(F.substring_index(address, "%", 1))
    head = _groups(F.substring_index(plain, "::", 1))
    tail = _groups(F.when(plain.contains("::"), F.substring_index(plain, "::", -1)).otherwise(""))
    # An IPv4 address at the end stands for two groups.
    given = F.size(head) + F.size(tail) + F.when(plain.contains("."), 1).otherwise(0)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0)))
    groups = F.transform(F.slice(F.concat(head, zeros, tail), 1, 4),
                         lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(ipv4_num(address).isNotNull(), F.substring_index(address, ".", 3)).when(
        is_ipv6(address), F.array_join(groups, ":"))


def under_suffix(name: Column, suffixes: list[str]) -> Column:
    """The name equals a suffix or ends with a dot and the suffix, ignoring case."""
    lowered = F.lower(name)
    hit = F.lit(False)
    for suffix in suffixes:
        bare = suffix.lower().lstrip(".")
        hit = hit | (lowered == bare) | lowered.endswith("." + bare)
    return F.coalesce(hit, F.lit(False))


def label_count(name: Column) -> Column:
    return F.size(F.split(F.rtrim(name, F.lit(".")), r"\."))


def name_suffix(name: Column, labels: int = 2) -> Column:
    """The last labels of a DNS or server name, in lower case."""
    return F.substring_index(F.lower(F.rtrim(name, F.lit("."))), ".", -labels)


def name_labels(name: Column) -> Column:
    """Suffix, label count and length of a name."""
    return F.struct(
        name_suffix(name).alias("suffix"),
        label_count(name).alias("labels"),
        F.length(name).alias("length"),
    )


# Services known by transport and port.
KNOWN_SERVICES = (
    ("UDP", 3478, "stun"),
    ("UDP", 41641, "overlay_vpn"),
    ("TCP", 8883, "mqtt"),
    ("UDP", 5353, "mdns"),
)


def service_of(proto: Column, port: Column, services=KNOWN_SERVICES) -> Column:
    """Service name for a transport and port pair, null when it is not listed."""
    out = F.lit(None).cast("string")
    for transport, number, name in reversed(list(services)):
        out = F.when((F.upper(proto) == transport) & (port == number), name).otherwise(out)
    return out
