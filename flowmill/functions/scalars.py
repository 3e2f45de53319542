"""Scalar functions over flow elements, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of numbers in their usual registries.
PROTOCOLS = {1: "ICMP", 2: "IGMP", 4: "IPv4", 6: "TCP", 8: "EGP", 17: "UDP", 27: "RDP", 41: "IPv6", 46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH", 58: "IPv6-ICMP", 88: "EIGRP", 89: "OSPFIGP", 97: "ETHERIP", 103: "PIM", 111: "IPX-in-IP", 112: "VRRP", 115: "L2TP", 124: "ISIS over IPv4", 130: "SPS", 132: "SCTP", 136: "UDPLite"}
HTTP_METHODS = dict(enumerate("GET POST HTTP HEAD PUT OPTIONS DELETE TRACE CONNECT PATCH".split(), 1))
SIP_METHODS = dict(enumerate("INVITE ACK BYE CANCEL OPTIONS REGISTER PRACK SUBSCRIBE NOTIFY PUBLISH INFO REFER MESSAGE UPDATE".split(), 1))
DNS_RCODES = dict(enumerate("NoError FormErr ServFail NXDomain NotImp Refused YXDomain YXRRSet NXRRSet NotAuth NotZone".split())) | dict(enumerate("BADVERS/BADSIG BADKEY BADTIME BADMODE BADNAME BADALG BADTRUNC".split(), 16))
TLS_VERSIONS = {0x0002: "SSLv2.0", 0x0005: "TLSv1.0 (SKYPE)", 0x0300: "SSLv3.0", 0x0301: "TLSv1.0", 0x0302: "TLSv1.1", 0x0303: "TLSv1.2", 0x0304: "TLSv1.3 (HYPOTHETICAL)", 0x0399: "TLSv1.152 (HYPOTHETICAL)", 0x0499: "TLSv2.152 (HYPOTHETICAL)", 0x2300: "SSLv2.0 (SSLv3.0)", 0x2301: "SSLv2.0 (TLSv1.0)", 0x2302: "SSLv2.0 (TLSv1.1)", 0x2303: "SSLv2.0 (TLSv1.2)"}
VOIP_TYPES = {0: "NO VOIP", 1: "SERV REQUEST", 2: "SERV REPLY", 3: "CALL REQUEST", 4: "CALL REPLY", 8: "VOICE DATA", 16: "RTCP"}
HTTP_STATUS = {100: "Continue", 101: "Switching Protocols", 102: "Processing", 200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information", 204: "No Content", 205: "Reset Content", 206: "Partial Content", 207: "Multi-Status", 208: "Already Reported", 226: "IM Used", 300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 305: "Use Proxy", 306: "(Unused)", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Request Entity Too Large", 414: "Request-URI Too Long", 415: "Unsupported Media Type", 416: "Requested Range Not Satisfiable", 417: "Expectation Failed", 422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests", 431: "Request Header Fields Too Large", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 506: "Variant Also Negotiates", 507: "Insufficient Storage", 508: "Loop Detected", 510: "Not Extended", 511: "Network Authentication Required"}
SIP_TYPES = {0: "Invalid", 1: "Invite", 2: "Ack", 3: "Cancel", 4: "Bye", 5: "Register", 6: "Options", 7: "Publish", 8: "Notify", 9: "Info", 10: "Subscribe", 99: "Status", 100: "Trying", 101: "Dial Established", 180: "Ringing", 183: "Session Progress", 200: "OK", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 407: "Proxy Auth Required", 486: "Busy Here", 487: "Request Canceled", 500: "Internal Error", 603: "Decline", 999: "Undefined"}
RTP_CODECS = {0: "PCMU", 3: "GSM", 4: "G723", 5: "DVI4", 6: "DVI4", 7: "LPC", 8: "PCMA", 9: "G722", 10: "L16", 11: "L16", 12: "QCELP", 13: "CN", 14: "MPA", 15: "G728", 16: "DVI4", 17: "DVI4", 18: "G729", 25: "CelB", 26: "JPEG", 28: "nv", 31: "H261", 32: "MPV", 33: "MP2T", 34: "H263"}
SMTP_STATUS = "SHRCOUV|I|NMLSP|CAISPMUENFR|"  # the letter of each bit in turn; a bar between hundreds
SMTP_COMMANDS = "EH HE ML RC D RST VF EX HLP N Q".split()


def named(c: Column, names: dict[int, str]) -> Column:
    """The name of a number, or the number as text; null stays null."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c.cast("int")), c.cast("string"))


def number_of(c: Column, names: dict[int, str]) -> Column:
    """The number of a name, in any case of letters (the first number, if several have it), or that which the text is; else null."""
    first = {name.lower(): number for number, name in reversed(names.items())}
    table = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(c)), c.try_cast("int"))


def ipv4_number(c: Column) -> Column:
    """The number of an address in four parts; null for anything else."""
    parts = F.transform(F.split(c, r"\."), lambda x: x.try_cast("long"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x.between(0, 255))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda out, x: out * 256 + x))


def flags_number(c: Column) -> Column:
    """The bits of letters out of FSRPAU, in any order and case."""
    upper = F.upper(c)
    return sum((F.when(F.contains(upper, F.lit(x)), bit).otherwise(0) for x, bit in zip("FSRPAU", (1, 2, 4, 8, 16, 32), strict=True)), F.lit(0)) + F.when(c.isNull(), F.lit(None).cast("int")).otherwise(0)


def mac_number(c: Column) -> Column:
    return F.conv(F.replace(c, F.lit(":"), F.lit("")), 16, 10).cast("long")


def ipv6_compact(c: Column) -> Column:
    """RFC 5952: groups without leading zeros, the first longest run of two zero groups or more as ::."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lower(F.regexp_replace(F.hex(F.substring(c, k * 2 + 1, F.lit(2))), "^0{1,3}", "")))
    plain = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    out = plain
    for n in range(2, 9):  # the longest run wins, as it is tried last
        run = ":" + "0:" * n
        out = F.when(F.contains(plain, F.lit(run)), F.concat(F.substring_index(plain, run, 1), F.lit("::"), F.substring(plain, F.instr(plain, run) + len(run), F.lit(64)))).otherwise(out)
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", ""))


def http_status(c: Column) -> Column:
    reason = F.try_element_at(F.create_map(*(F.lit(x) for pair in HTTP_STATUS.items() for x in pair)), c.cast("int"))
    return F.when(c.isNotNull(), F.concat_ws(" ", c.cast("string"), reason))


def rtp_codec(c: Column) -> Column:
    """The codec of a payload type; else whether its number is reserved, unassigned or dynamic."""
    table = F.create_map(*(F.lit(x) for pair in RTP_CODECS.items() for x in pair))
    rest = F.when(c.between(72, 76) | (c <= 19), "Reserved").when(c <= 95, "Unassigned").otherwise("dynamic")
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c.cast("int")), rest))


def smtp_status(c: Column) -> Column:
    """A letter in its place for each bit that is set, a dash for each that isn't; last spam (S) and unknown (U)."""
    shown = [F.lit("|") if x == "|" else F.when(c.bitwiseAND(1 << k - SMTP_STATUS[:k].count("|")) > 0, x).otherwise("-") for k, x in enumerate(SMTP_STATUS)]
    ends = [F.when(c.bitwiseAND(bit) > 0, x).otherwise("-") for x, bit in (("S", 1 << 30), ("U", 1 << 31))]
    return F.when(c.isNotNull(), F.concat(*shown, *ends))


def json_text(c: Column, keep_control: bool = False) -> Column:
    """A JSON string; control characters go unless they are kept, as escapes."""
    kept = c if keep_control else F.regexp_replace(c, "[\\x00-\\x1F]", "")
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(kept)), r"^\[|\]$", ""))


def ntp_millis(c: Column) -> Column:
    """Milliseconds since 1970 of an NTP time: 32 bits of seconds since 1900, 32 of their fraction."""
    seconds, part = F.shiftrightunsigned(c, 32), c.bitwiseAND((1 << 32) - 1)
    return (seconds - 2208988800) * 1000 + F.shiftrightunsigned(part * 1000, 32)


def multiplied(c: Column, by: float, decimals: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c * F.lit(float(by))))


def truncated6(c: Column) -> Column:
    """IPv6 with all but its first 7 bytes and its last cleared."""
    return F.concat(F.substring(c, 1, 7), F.unhex(F.lit("00" * 8)), F.substring(c, 16, 1))


def source_crc(address: Column, port: Column) -> Column:
    return F.crc32(F.concat(address, port.cast("string")).cast("binary"))


def ipv4_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat_ws(".", *(F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))


def ipv6_text(c: Column) -> Column:
    """All eight groups of four digits."""
    return F.regexp_replace(F.lower(F.hex(c)), "(.{4})(?!$)", "$1:")


def mac_text(c: Column) -> Column:
    return F.regexp_replace(F.lpad(F.lower(F.hex(c)), 12, "0"), "(.{2})(?!$)", "$1:")


def flags_text(c: Column) -> Column:
    return F.concat(*(F.when(c.bitwiseAND(bit) > 0, letter).otherwise(".") for letter, bit in zip("UAPRSF", (32, 16, 8, 4, 2, 1), strict=True)))


def smtp_commands(c: Column) -> Column:
    bits = [F.when(c.bitwiseAND(1 << k) > 0, name) for k, name in enumerate(SMTP_COMMANDS)]
    return F.concat_ws(",", *bits, F.when(c.bitwiseAND(0x8000) > 0, "U"))


def human(c: Column) -> Column:
    """Numbers above a million as x.y M, G or T."""
    scaled = lambda by, unit: F.concat(F.format_string("%.1f", c / F.lit(float(by))), F.lit(f" {unit}"))
    return F.when(c > 10**12, scaled(10**12, "T")).when(c > 10**9, scaled(10**9, "G")).when(c > 10**6, scaled(10**6, "M")).otherwise(c.cast("string"))


def timestamp_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def seconds_text(ms: Column) -> Column:
    return F.format_string("%.3f", ms / F.lit(1000.0))


def duration() -> Column:
    """Milliseconds from start to end; null where the end comes first."""
    d = F.col("e0id153") - F.col("e0id152")
    return F.when(d >= 0, d)


def _per(c: Column, by: Column) -> Column:
    # whole numbers; 0 where nothing passed
    return F.when(by == 0, F.lit(0)).otherwise(F.floor(c / F.nullif(by, F.lit(0)))).cast("long")


def packets_per_second() -> Column:
    return _per(F.col("e0id2") * 1000, duration())


def bits_per_second() -> Column:
    return _per(F.col("e0id1") * 8000, duration())


def bytes_per_packet() -> Column:
    return _per(F.col("e0id1"), F.col("e0id2"))


def window_start(ms: Column, step: int) -> Column:
    return (ms - F.pmod(ms, F.lit(step))).cast("long")


def truncated(c: Column, bits: int = 16) -> Column:
    """IPv4 with its last bits cleared."""
    return c.bitwiseAND(((1 << 32) - 1) ^ ((1 << bits) - 1))


def prefix_preserving(c: Column, key: bytes) -> Column:
    """Crypto-PAn of an IPv4 address: addresses that share a prefix still do, of the same length and no longer.

    key: 16 bytes for AES, then 16 whose encryption pads the blocks. Each bit is flipped by the first bit of
    the encrypted block that begins with the bits before it.
    """
    aes = F.lit(key[:16])
    first = lambda block: F.conv(F.hex(F.substring(F.aes_encrypt(block, aes, F.lit("ECB"), F.lit("PKCS")), 1, 4)), 16, 10).cast("long")
    pad = F.substring(F.aes_encrypt(F.lit(key[16:32]), aes, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    pad4 = F.conv(F.hex(F.substring(pad, 1, 4)), 16, 10).cast("long")
    rest = F.substring(pad, 5, 12)

    def step(out: Column, k: Column) -> Column:
        # SQL's shifts by a column: through powers of two
        keep = F.expr("4294967295") - F.pow(F.lit(2.0), F.lit(32) - k).cast("long") + 1
        head = c.bitwiseAND(keep).bitwiseOR(pad4.bitwiseAND(F.expr("4294967295") - keep))
        block = F.concat(F.unhex(F.lpad(F.hex(head), 8, "0")), rest)
        return out * 2 + F.shiftright(first(block), 31).bitwiseAND(1)

    flips = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), step)
    return F.when(c.isNotNull(), c.bitwiseXOR(flips))
