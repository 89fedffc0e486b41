"""Reversible encodings: column expressions where built-ins suffice, Arrow UDFs for the rest.

Decoders return struct(value, error): exactly one of the two is null.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- hex and binary digits --------------------------------------------------------------------------


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def parse_hex(text: Column) -> Column:
    """Bytes of hex digits in any case; ASCII white space does not count."""
    digits = F.regexp_replace(text, r"[ \t\n\f\r]", "")
    error = F.when(~digits.rlike("^[0-9A-Fa-f]*$"), "invalid hex digit").when(F.length(digits) % 2 == 1, "odd number of hex digits")
    return F.struct(F.when(error.isNull(), F.unhex(digits)).alias("value"), error.alias("error"))


def to_binary_digits(data: Column) -> Column:
    """Eight binary digits for each byte, the high bit first."""
    # fifteen hex digits at a time: what a LONG holds
    digits = F.regexp_extract_all(F.hex(data), F.lit(".{1,15}"), F.lit(0))
    return F.array_join(F.transform(digits, lambda o: F.lpad(F.bin(F.conv(o, 16, 10).cast("long")), F.length(o) * 4, "0")), "")


def parse_binary_digits(text: Column) -> Column:
    """Bytes of binary digits, eight each; ASCII white space does not count."""
    digits = F.regexp_replace(text, r"[ \t\n\f\r]", "")
    error = F.when(~digits.rlike("^[01]*$"), "invalid binary digit").when(F.length(digits) % 8 != 0, "number of bits is not a multiple of 8")
    # cut in one pass, 64 digits at a time; substring() would walk from the start for each piece
    words = F.transform(F.regexp_extract_all(digits, F.lit("[01]{1,64}"), F.lit(0)), lambda o: F.lpad(F.conv(o, 2, 16), F.shiftright(F.length(o), 2), "0"))
    value = F.when(F.length(digits) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(words, "")))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


# --- base 36 and global ids ---------------------------------------------------------------------------

#: The 22 tag bits in front of each kind's id.
TAGS = {
    "game": "81A99C", "user": "BACAE0", "run": "AEE9E8", "category": "71AB78", "level": "96F948",
}


def base36_decode(text: Column) -> Column:
    """Id of exactly eight small base-36 digits."""
    error = F.when(F.length(text) != 8, "wrong length").when(~text.rlike("^[0-9a-z]{8}$"), "invalid digit")
    return F.struct(F.when(error.isNull(), F.conv(text, 36, 10).cast("long")).alias("value"), error.alias("error"))


def base36_encode(number: Column) -> Column:
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 8, "0")


def global_id(kind: str, number: Column) -> Column:
    """base64url of 22 tag bits and 42 id bits, without padding."""
    tag = int(TAGS[kind], 16) << 40
    tag -= 1 << 64 if tag >= 1 << 63 else 0
    packed = F.unhex(F.lpad(F.hex(F.lit(tag).bitwiseOR(number.cast("long"))), 16, "0"))
    return F.regexp_replace(F.translate(F.base64(packed), "+/", "-_"), "=+$", "")


def parse_global_id(text: Column) -> Column:
    """struct(kind, id); null for another text."""
    raw = F.hex(F.try_to_binary(F.concat(F.translate(text, "-_", "+/"), F.lit("=")), F.lit("base64")))
    kind = F.coalesce(*[F.when(F.substring(raw, 1, 2) == tag[:2], kind) for kind, tag in TAGS.items()])
    low = F.conv(F.substring(raw, 5, 12), 16, 10).cast("long").bitwiseAND((1 << 42) - 1)
    return F.when(text.rlike("^[A-Za-z0-9_-]{11}$") & kind.isNotNull(), F.struct(kind.alias("kind"), low.alias("id")))


# --- hashes -------------------------------------------------------------------------------------------


def git_blob_id(content: Column) -> Column:
    """SHA-1 of a blob's header and content."""
    data = content.cast("binary")
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8")
    return F.sha1(F.unhex(F.concat(F.hex(header), F.lit("00"), F.hex(data))))


def git_tree_id(entries: Column) -> Column:
    """SHA-1 of a flat tree: array of struct(mode, name, id hex), ordered by name as a tree orders it."""
    ordered = F.array_sort(entries, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    body = F.array_join(
        F.transform(ordered, lambda e: F.concat(F.hex(F.encode(F.concat(e["mode"], F.lit(" "), e["name"]), "UTF-8")), F.lit("00"), F.upper(e["id"]))), ""
    )
    header = F.hex(F.encode(F.concat(F.lit("tree "), (F.length(body) / 2).cast("long").cast("string")), "UTF-8"))
    return F.sha1(F.unhex(F.concat(header, F.lit("00"), body)))


# --- Z85 ----------------------------------------------------------------------------------------------

#: Fixed value: the digits of Z85.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
_DIGITS = np.frombuffer(Z85.encode(), np.uint8)
_POWERS = np.array([85**4, 85**3, 85**2, 85, 1], np.int64)
_VALUES = np.full(256, -1, np.int64)
_VALUES[_DIGITS] = np.arange(85)
_PAIRS = [a + b for a in Z85 for b in Z85]
_VALUE = {d: k for k, d in enumerate(Z85)}


def _five(word: int) -> str:
    return Z85[word // 52200625] + _PAIRS[word // 7225 % 7225] + _PAIRS[word % 7225]


def z85_encode(data: bytes) -> str:
    """Z85 with a short last block: n bytes give n + 1 digits."""
    spare = -len(data) % 4
    if len(data) <= 64:  # arrays do not pay
        padded = bytes(data) + b"\0" * spare
        digits = "".join([_five(int.from_bytes(padded[i : i + 4], "big")) for i in range(0, len(padded), 4)])
        return digits[: len(digits) - spare]
    words = np.frombuffer(data + b"\0" * spare, ">u4").astype(np.int64)
    digits = _DIGITS[words[:, None] // _POWERS % 85].tobytes()
    return digits[: len(digits) - spare].decode()


def z85_decode(text: str) -> bytes:
    """Inverse of z85_encode; white space does not count. Raises ValueError."""
    raw = np.frombuffer(re.sub(r"[ \t\n\f\r]", "", text).encode(), np.uint8)
    values = _VALUES[raw]
    if (values < 0).any():
        raise ValueError("invalid digit")
    if len(raw) % 5 == 1:
        raise ValueError("a single digit is left over")
    spare = -len(raw) % 5  # the highest digit fills up, as the encoder cut
    words = (np.concatenate((values, np.full(spare, 84))).reshape(-1, 5) * _POWERS).sum(1)
    if (words >= 1 << 32).any():
        raise ValueError("a block is out of range")
    out = words.astype(">u4").tobytes()
    return out[: len(out) - spare]


def z85_length(count: Column) -> Column:
    """Digits of so many bytes."""
    return F.floor(count / 4) * 5 + F.when(count % 4 == 0, 0).otherwise(count % 4 + 1)


def z85_decoded_length(count: Column) -> Column:
    """Bytes of so many digits."""
    return F.floor(count / 5) * 4 + F.greatest(count % 5 - 1, F.lit(0))


def mixed85_encode(data: bytes) -> str:
    """Z85, but runs of blocks of printable ASCII stay as they are behind a `|`.

    A single raw block is `|` and its 4 bytes. A longer run is the number of blocks less one in Z85 digits
    without leading zeros, `|`, the bytes, and `.` up to the length that Z85 would have; the first of those
    dots repeat the text that follows and close with `|`. A run at the end has `0|` or, up to one block, `|`.
    """
    blocks = [data[i : i + 4] for i in range(0, len(data), 4)]
    printable = [all(32 <= b < 127 for b in block) for block in blocks]
    out, i = [], 0
    while i < len(blocks):
        if not printable[i]:
            out.append(z85_encode(blocks[i]))
            i += 1
            continue
        end = next((k for k in range(i, len(blocks)) if not printable[k]), len(blocks))
        raw, count = b"".join(blocks[i:end]).decode(), end - i
        if end == len(blocks):
            out.append(("0" if len(raw) > 4 else "") + "|" + raw)
        elif count == 1:
            out.append("|" + raw)
        else:
            prefix = z85_encode((count - 1).to_bytes(4, "big")).lstrip("0") + "|"
            room = count * 5 - len(prefix) - len(raw)
            echo = re.match(rb"[ -~]*", blocks[end])[0].decode() + "|"
            out.append(prefix + raw + (echo[:room] + "." * room)[:room])
        i = end
    return "".join(out)


# --- B1032: decimal below 10000, base 32 with a letter above --------------------------------------------

#: The digits, and the first value from which tokens are plain base 32.
BASE32_DIGITS, PLAIN_FROM = "0123456789ABCDEFGHIJKLMNOPQRSTUV", 304_426


@cache
def _lettered() -> np.ndarray:
    """Values below 32 ** 4 whose four base-32 digits hold a letter, in order."""
    v = np.arange(32**4, dtype=np.int32)
    lettered = np.zeros(len(v), bool)
    for shift in (0, 5, 10, 15):
        lettered |= (v >> shift & 31) >= 10
    return v[lettered]


def b1032_rank(value: int) -> int:
    """How many lettered values lie below a lettered value."""
    return int(np.searchsorted(_lettered(), value))


def b1032_unrank(rank: int) -> int:
    return int(_lettered()[rank])


def b1032_encode(number: int) -> str:
    if number < 0:
        return "-" + b1032_encode(-number)
    if number < 10_000:
        return str(number)
    value, out = number if number >= PLAIN_FROM else b1032_unrank(number - 10_000), ""
    while value or len(out) < 4:
        out, value = BASE32_DIGITS[value & 31] + out, value >> 5
    return out


def b1032_decode(token: str, low: int = -(2**63), high: int = 2**63 - 1) -> int:
    """Inverse of b1032_encode, any case; raises ValueError for empty, invalid or overflowing tokens."""
    if token.startswith("-") and low < 0:
        value = -b1032_decode(token[1:], 0, -low)
    elif not re.fullmatch("[0-9A-Va-v]*", token):
        raise ValueError("invalid character")
    elif not token:
        raise ValueError("empty token")
    else:
        digits = token.lstrip("0") or "0"
        value = int(digits, 10 if digits.isdigit() and len(digits) <= 4 else 32)
        if not (digits.isdigit() and len(digits) <= 4) and value < PLAIN_FROM:
            value = 10_000 + b1032_rank(value)
    if not low <= value <= high:
        raise ValueError("overflow")
    return value


# --- escaped text, masked hex, blocks of any alphabet ----------------------------------------------------

_ESCAPES = {"\\n": 10, "\\t": 9, "\\r": 13, "\\\\": 92}


_SHOWN = [{v: k for k, v in _ESCAPES.items()}.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02X}") for b in range(256)]
_HIDDEN = re.compile(r"[^ -\[\]-~]+")
_ESCAPED = re.compile(r"(?:[\x00-\x5b\x5d-\x7f]++|\\x[0-9A-Fa-f]{2}|\\[ntr\\])*+")
_ESCAPE_RUNS = re.compile(rb"(?:\\x..)+|\\.")


def bytes_to_text(data: bytes) -> str:
    """Printable ASCII as it is; line break, tab, return and backslash escaped; other bytes as \\xHH."""
    return _HIDDEN.sub(lambda m: "".join([_SHOWN[ord(c)] for c in m[0]]), data.decode("latin-1"))


def text_to_bytes(text: str) -> bytes | None:
    """Inverse of bytes_to_text; None for a malformed text."""
    if not _ESCAPED.fullmatch(text):
        return None
    return _ESCAPE_RUNS.sub(lambda m: bytes.fromhex(m[0].replace(b"\\x", b"").decode()) if m[0][1:2] == b"x" else bytes([_ESCAPES[m[0].decode()]]), text.encode())


def masked_hex(text: str) -> tuple[bytes, bytes]:
    """(bytes, mask) of hex nibbles; `_` is any nibble, mask 0. An odd nibble at the end is a high one."""
    digits = re.sub(r"[ \n\t,;\"']", "", re.sub("^0[xX]", "", text))
    if not re.fullmatch("[0-9A-Fa-f_]*", digits):
        raise ValueError("invalid nibble")
    even = digits + "0" * (len(digits) % 2)
    mask = re.sub("[^_]", "F", digits).replace("_", "0") + "0" * (len(digits) % 2)
    return bytes.fromhex(even.replace("_", "0")), bytes.fromhex(mask)


#: Digits and bytes in a block of the standard encodings.
ALPHABETS = {
    "hex": ("0123456789ABCDEF", 1),
    "hex_lowercase": ("0123456789abcdef", 1),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 5),
    "base32_lowercase": ("abcdefghijklmnopqrstuvwxyz234567", 5),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3),
    "base64_url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3),
    "z85": (Z85, 4),
}


def block_encode(data: bytes, digits: str, size: int) -> str:
    """Digits of each block of size bytes as one big-endian number; a short last block keeps as many as it needs."""
    base, out = len(digits), []
    needs = [next(w for w in range(99) if base**w >= 256**n) for n in range(size + 1)]
    width = needs[size]
    for at in range(0, len(data), size):
        block = data[at : at + size]
        value, text = int.from_bytes(block.ljust(size, b"\0"), "big"), ""
        for _ in range(width):
            value, digit = divmod(value, base)
            text = digits[digit] + text
        out.append(text[: needs[len(block)]])
    return "".join(out)


# --- base 66 and base 92: block encodings that leave runs of safe characters readable ------------------------

#: Bytes and digits in a block, the mark of a run, most blocks in a run, fill, safe characters.
READABLE = {
    "66": (3, 4, ".", 99, "~.-_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "92": (4, 5, "|", 999, ".-:+=^!/*?&<>()[]{}@%$#,;~|_ 0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
}


def _plain_digits(base: str, data: bytes) -> str:
    if base == "66":
        return base64.urlsafe_b64encode(data).rstrip(b"=").decode()
    return z85_encode(data)


def _plain_bytes(base: str, text: str) -> bytes:
    if base == "66":
        if not re.fullmatch("[A-Za-z0-9_-]*", text) or len(text) % 4 == 1:
            raise ValueError("invalid digits")
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    return z85_decode(text)


@cache
def _safe_runs(base: str, extra_safe: str) -> re.Pattern:
    """Runs of whole safe blocks, the first group, or of others; every match begins at a block."""
    size, _, _, most, safe = READABLE[base]
    block = b"[" + re.escape((safe + extra_safe).encode()) + b"]{%d}" % size
    return re.compile(b"((?:%s){1,%d})|(?:(?!%s).{1,%d})+" % (block, most, block, size), re.DOTALL)


def readable_encode(data: bytes, base: str, extra_safe: str = "") -> str:
    """base64url (66) or Z85 (92), but whole blocks of safe characters stay as they are, in marked runs.

    A run of one block is `~` and its bytes; of two, the mark twice and the bytes; of n, mark n mark, the bytes,
    and a fill up to the length of n blocks. A run longer than its base allows is cut into several.
    """
    size, width, mark, _, _ = READABLE[base]
    out = []
    for found in _safe_runs(base, extra_safe).finditer(data):
        if found[1] is None:
            out.append(_plain_digits(base, found[0]))
            continue
        raw = found[1].decode()
        n = len(found[1]) // size
        text = "~" + raw if n == 1 else mark * 2 + raw if n == 2 else f"{mark}{n}{mark}{raw}"
        if len(text) < n * width and (n == 4 or base == "66"):
            text += mark
        out.append(text.ljust(n * width, "."))
    return "".join(out)


#: Whole blocks without a mark in front, and the length of a run, of each base.
_PLAIN_RUN = {b: re.compile(rf"(?:(?![~{re.escape(mark)}]).{{{width}}})+", re.DOTALL) for b, (_, width, mark, _, _) in READABLE.items()}
_RUN_LENGTH = {b: re.compile(rf"{re.escape(mark)}([1-9][0-9]*){re.escape(mark)}") for b, (_, _, mark, _, _) in READABLE.items()}


def _plain_run(base: str, text: str) -> bytes:
    """Bytes of whole blocks, together where each is only digits, else block by block."""
    width = READABLE[base][1]
    try:
        if not re.search(r"\s", text):
            return _plain_bytes(base, text)
    except ValueError:
        pass
    return b"".join([_plain_bytes(base, text[i : i + width]) for i in range(0, len(text), width)])


def readable_decode(text: str, base: str, strict: bool = False) -> bytes:
    """Inverse of readable_encode; strict rejects what the encoder would write in another way."""
    size, width, mark, _, _ = READABLE[base]
    out, at = [], 0
    while at < len(text):
        plain = _PLAIN_RUN[base].match(text, at)
        if plain:
            out.append(_plain_run(base, plain[0]))
            at = plain.end()
            continue
        if len(text) - at < width:
            out.append(_plain_bytes(base, text[at:]))
            break
        n, skip = 1, 1
        if text[at] != "~":
            number = _RUN_LENGTH[base].match(text, at)
            if text[at + 1] == mark:
                n, skip = 2, 2
            elif number:
                n, skip = int(number[1]), number.end() - at
            else:
                raise ValueError("a run without a length")
        raw = text[at + skip : at + skip + n * size].encode()
        if len(raw) != n * size or at + n * width > len(text):
            raise ValueError("a run is cut short")
        out.append(raw)
        at += n * width
    data = b"".join(out)
    if strict and readable_encode(data, base) != text:
        raise ValueError("not the canonical form")
    return data


# --- Z85 with escapes for raw runs -----------------------------------------------------------------------------

#: Raw bytes after an escape at a block's start, and, behind one to three prefix digits, the raw
#: bytes and whether the prefix is little-endian.
ESCAPE_FIRST = {"_": 7, ";": 6, "~": 5, ",": 4, "`": 3}
ESCAPE_LATER = {"_": (7, True), ";": (6, True), "~": (6, False), ",": (4, True), "`": (4, False)}
_ESCAPED_SAFE = (Z85 + ",`;~_|").encode()
_UNSAFE = bytes(b not in _ESCAPED_SAFE for b in range(256))
#: The escape of a run of so many bytes, up to the longest that counts.
_FIRST = [next(((e, c) for e, c in ESCAPE_FIRST.items() if run >= c), None) for run in range(11)]
_LATER = [[(e, c, le) for e, (c, le) in ESCAPE_LATER.items() if run >= c] for run in range(8)]
_SPOT = re.compile("[,`;~_|]")


def _number_digits(value: int, width: int) -> str:
    if width == 5 and value < 85**5:
        return _five(value)
    out = ""
    for _ in range(width):
        value, digit = divmod(value, 85)
        out = Z85[digit] + out
    return out


def _digits_number(digits: str) -> int:
    value = 0
    for d in digits:
        if d not in _VALUE:
            raise ValueError(f"invalid digit {d!r}")
        value = value * 85 + _VALUE[d]
    return value


def escaped85_encode(data: bytes) -> str:
    """Z85 in which an escape stands for a fixed number of raw bytes, filled with `.` to whole blocks of five.

    The longest raw run at a block's start is taken; else the shortest prefix of one to three bytes that as
    many digits can hold and that a run follows; else a block of four bytes. A short last block is
    right-aligned: n bytes are the last n + 1 digits of their number.
    """
    out, at = [], 0
    unsafe = data.translate(_UNSAFE) + b"\1"
    while at < len(data):
        bad = unsafe.find(1, at)
        escape, prefix, count = None, "", 0
        if found := _FIRST[min(bad - at, 10)]:
            escape, count = found
        for size in range(1, 4) if not escape else ():
            if at + size >= len(data):
                break
            if bad < at + size:
                bad = unsafe.find(1, at + size)
            for e, c, le in _LATER[min(bad - at - size, 7)]:
                value = int.from_bytes(data[at : at + size], "little" if le else "big")
                if value < 85**size:
                    escape, count, prefix = e, c, _number_digits(value, size)
                    break
            if escape:
                break
        if escape:
            start = at + len(prefix)
            text = prefix + escape + data[start : start + count].decode()
            out.append(text + "." * (-len(text) % 5))
            at = start + count
        else:
            block = data[at : at + 4]
            out.append(_number_digits(int.from_bytes(block, "big"), len(block) + 1))
            at += 4
    return "".join(out)


def escaped85_decode(text: str) -> bytes:
    """Inverse of escaped85_encode; also takes `|` runs, whose length in base 42 stands before the mark (0: to the end)."""
    out, at = [], 0
    while at < len(text):
        block = text[at : at + 5]
        spot = found.start() - at if (found := _SPOT.search(text, at, at + 5)) else None
        if spot is None:
            value, size = _digits_number(block), len(block) * 4 // 5
            if len(block) == 5 and value >= 1 << 32:
                raise ValueError("a block is out of range")
            out.append((value % 256**size).to_bytes(size, "big"))
            at += 5
            continue
        escape = block[spot]
        if len(block) < 5 and escape != "|":
            raise ValueError("an escape in a short block")
        start = at + spot + 1
        if escape == "|":
            count = base42_length(block[:spot], spot in (0, 4))[0] or len(text) - start
        elif spot == 0:
            count = ESCAPE_FIRST[escape]
        elif spot <= 3:
            count, little = ESCAPE_LATER[escape]
            value = _digits_number(block[:spot])
            out.append((value % 256**spot).to_bytes(spot, "little" if little else "big"))
        else:
            raise ValueError("an escape at the end of a block")
        raw = text[start : start + count].encode()
        if len(raw) < count:
            raise ValueError("raw bytes are missing")
        out.append(raw)
        at = -(-(start + count) // 5) * 5
    return b"".join(out)


def base42_digits(length: int, little: bool | None = None) -> str:
    """A raw run's length, 0 or from 8 on, in base 42: digits are one up, all but the first another 42 up.

    With little given, the first digit also tells the byte order: 21 up for big-endian.
    """
    if length and not 8 <= length < 42**4:
        raise ValueError("no length of a raw run")
    values, rest = [], length
    while rest or not values:
        rest, digit = divmod(rest, 42)
        values.insert(0, digit)
    if little is not None:
        if values[0] > 20:
            raise ValueError("no room for the byte order")
        values[0] += 0 if little else 21
    return "".join(Z85[v + 1 + (42 if k else 0)] for k, v in enumerate(values))


def base42_length(digits: str, aligned: bool) -> tuple[int, bool]:
    """(length, little-endian) of base-42 digits; aligned ones carry no byte order."""
    total, little = 0, True
    for k, d in enumerate(digits):
        value = _digits_number(d) - 1
        if value < 0:
            raise ValueError("invalid length digit")
        value %= 42
        if k == 0 and not aligned:
            little, value = value < 21, value % 21
        total = total * 42 + value
    if 0 < total < 8:
        raise ValueError("a raw run is too short")
    return total, little


# --- as column functions -------------------------------------------------------------------------------


#: Arrow types of kinds, and values that are Python objects at one time.
_ARROW, _AT_ONCE = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}, 64


def _slices(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    """function(values) of slices, each an Arrow array before the next is made."""
    parts = [pa.array([function(v) for v in values.slice(i, _AT_ONCE).to_pylist()], kind) for i in range(0, len(values), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _each(function, kind: str):
    """An Arrow UDF that applies a function to every value; null stays null."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return _slices(values, lambda v: None if v is None else function(v), _ARROW[kind])

    return run


def _checked(function, kind: str):
    """The same with struct(value, error) from ValueError."""

    def checked(v):
        try:
            return {"value": None if v is None else function(v), "error": None}
        except ValueError as e:
            return {"value": None, "error": str(e)}

    @F.arrow_udf(f"value {kind}, error string")
    def run(values: pa.Array) -> pa.Array:
        return _slices(values, checked, pa.struct([("value", _ARROW[kind]), ("error", pa.string())]))

    return run


def z85(data: Column) -> Column:
    return _each(lambda b: z85_encode(bytes(b)), "string")(data.cast("binary"))


def parse_z85(text: Column) -> Column:
    return _checked(z85_decode, "binary")(text)


def mixed85(data: Column) -> Column:
    return _each(lambda b: mixed85_encode(bytes(b)), "string")(data.cast("binary"))


def b1032(number: Column) -> Column:
    return _each(lambda n: b1032_encode(int(n)), "string")(number.cast("string"))


def parse_b1032(token: Column) -> Column:
    return _checked(b1032_decode, "long")(token)


def escaped(data: Column) -> Column:
    return _each(lambda b: bytes_to_text(bytes(b)), "string")(data.cast("binary"))


def parse_escaped(text: Column) -> Column:
    return _each(text_to_bytes, "binary")(text)


def parse_masked_hex(text: Column) -> Column:
    @F.pandas_udf("bytes binary, mask binary, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((*((None, None) if v is None else masked_hex(v)), None))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["bytes", "mask", "error"]).astype(object)

    return run(text)


def encode_blocks(data: Column, alphabet: str) -> Column:
    digits, size = ALPHABETS[alphabet]
    if alphabet.startswith("hex"):
        return F.hex(data) if alphabet == "hex" else to_hex(data)
    if alphabet.startswith("base64"):
        out = F.rtrim(F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("="))  # no lines
        return out if alphabet == "base64" else F.translate(out, "+/", "-_")
    return _each(lambda b: block_encode(bytes(b), digits, size), "string")(data.cast("binary"))


def readable(data: Column, base: str) -> Column:
    return _each(lambda b: readable_encode(bytes(b), base), "string")(data.cast("binary"))


def parse_readable(text: Column, base: str) -> Column:
    return _checked(lambda t: readable_decode(t, base), "binary")(text)


def escaped85(data: Column) -> Column:
    return _each(lambda b: escaped85_encode(bytes(b)), "string")(data.cast("binary"))


def parse_escaped85(text: Column) -> Column:
    return _checked(escaped85_decode, "binary")(text)
