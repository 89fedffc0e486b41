"""Text functions as column expressions; Arrow UDFs only for the shell tokenizer."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space without the vertical tab.
SPACE = r"[ \t\n\f\r]"
#: Characters that a slug does not keep; each kept one by itself, which Java looks up in one table.
_OUT = rf"[^{string.ascii_letters}{string.digits}+\-/']"


def slugify(name: Column) -> Column:
    """Runs of other characters become `_`, none at the ends; `/` and `'` go; an empty slug is `_`."""
    # runs first: looking for one at the end of a text would walk every run from each of its characters
    slug = F.translate(F.btrim(F.regexp_replace(name, f"{_OUT}+", "_"), F.lit("_")), "/'", "")
    return F.when(slug == "", F.lit("_")).otherwise(slug)


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def duration_ms(iso: Column) -> Column:
    """Milliseconds of an ISO-8601 duration `PnDTnHnMn.nnnS`; fractions need three digits, else seconds count 0."""
    pattern = r"P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d\d\d))?S)?"
    part = lambda k: F.coalesce(F.expr("null").cast("long"), F.nullif(F.regexp_extract(iso, pattern, k), F.lit("")).cast("long"), F.lit(0).cast("long"))
    ms = (((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4)) * 1000 + part(5)
    return F.when(iso.rlike(pattern), ms)


def duration_text(ms: Column) -> Column:
    """`1h02m03.004s`; hours and minutes only where needed, `-` for 0."""
    ms = ms.cast("long")
    h, m, s, rest = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    tail = F.when(rest > 0, F.format_string(".%03d", rest)).otherwise(F.lit(""))
    full = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), F.format_string("%02d", m), F.lit("m"), F.format_string("%02d", s)))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), F.format_string("%02d", s)))
        .otherwise(s.cast("string"))
    )
    return F.when(ms == 0, F.lit("-")).otherwise(F.concat(full, tail, F.lit("s")))


def epoch_at_noon(date: Column) -> Column:
    """Seconds since the epoch at 12:08:04 UTC of a date."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + 43684


def zoned_time(iso: Column) -> Column:
    """struct(seconds, offset_minutes) of an ISO-8601 time with an offset or Z; null for another text."""
    pattern = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.\d+)?(Z|([+-])(\d\d):?(\d\d))$"
    part = lambda k: F.regexp_extract(iso, pattern, k)
    minutes = F.when(part(3) == "Z", 0).otherwise(F.when(part(4) == "-", -1).otherwise(1) * (part(5).try_cast("int") * 60 + part(6).try_cast("int")))
    local = F.datediff(part(1).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    clock = F.substring(part(2), 1, 2).try_cast("long") * 3600 + F.substring(part(2), 4, 2).try_cast("long") * 60 + F.substring(part(2), 7, 2).try_cast("long")
    return F.when(iso.rlike(pattern), F.struct((local + clock - minutes * 60).alias("seconds"), minutes.cast("int").alias("offset_minutes")))


def zoned_text(seconds: Column, offset_minutes: Column) -> Column:
    """ISO-8601 text of seconds and an offset; the inverse of zoned_time."""
    local = seconds + offset_minutes * 60
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / 86400).cast("int"))
    rest = F.pmod(local, F.lit(86400))
    size = F.abs(offset_minutes)
    sign = F.when(offset_minutes < 0, "-").otherwise("+")
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(day.cast("string"), F.lit("T"), clock, sign, F.format_string("%02d:%02d", F.floor(size / 60), size % 60))


def path_similarity(left: Column, right: Column) -> Column:
    """How many trailing path components two paths share."""
    a, b = F.reverse(F.split(left, "/")), F.reverse(F.split(right, "/"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(F.transform(same, lambda s: F.when(s, 1).otherwise(0)), 0)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")


def normal_path(path: Column) -> Column:
    """A path without empty and `.` components and without slashes at its ends."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")


def valid_requirement_id(text: Column) -> Column:
    """Dot-separated segments of letters, digits, `_` and `-`, none of them empty."""
    return F.coalesce(text.rlike(r"^[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)*$"), F.lit(False))


def modifiers(text: Column) -> Column:
    """struct(add, remove) of a modifier list such as `+a-b`."""
    found = F.regexp_extract_all(text, F.lit("([+-][^+-]+)"), F.lit(1))
    of = lambda sign: F.transform(F.filter(found, lambda m: F.startswith(m, F.lit(sign))), lambda m: F.substring(m, 2, 1 << 30))
    return F.struct(of("+").alias("add"), of("-").alias("remove"))


def graph_message(message: Column) -> Column:
    """struct(prefix, revision, generation, commits, origin) of `r5 / g6 / n7 / oHHHH`; null if it is none."""
    first = F.trim(F.split(message, " / ")[0])
    number = lambda p: F.nullif(F.regexp_extract(message, rf" / \s*{p}(\d+)\s*(?: / |$)", 1), F.lit("")).cast("long")
    origin = F.nullif(F.regexp_extract(message, r" / \s*o([0-9A-Fa-f]{1,4})\s*(?: / |$)", 1), F.lit(""))
    whole = F.struct(
        F.substring(first, 1, 1).alias("prefix"), F.substring(first, 2, 20).cast("long").alias("revision"), number("g").alias("generation"),
        number("n").alias("commits"), F.conv(origin, 16, 10).cast("int").alias("origin"),
    )
    return F.when(first.rlike(r"^[rsz]\d{1,10}$"), whole)


def video_url(video: Column) -> Column:
    """Address of a video struct(kind, id, start, url)."""
    start = F.coalesce(F.concat(F.lit("&t="), video["start"].cast("string")), F.lit(""))
    return F.when(video["kind"] == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), video["id"], start)).otherwise(video["url"])


def yaml_plain(text: Column) -> Column:
    """Whether a string may stand unquoted in YAML: a plain word that no reader takes for another type."""
    word = text.rlike(r"\A[A-Za-z_][A-Za-z0-9_./ -]*\z") & ~F.endswith(text, F.lit(" "))
    return F.coalesce(word & ~F.lower(text).isin("true", "false", "null", "yes", "no", "on", "off", "y", "n", "nan", "inf"), F.lit(False))


def yaml_scalar(text: Column) -> Column:
    """A string as a YAML scalar: plain, or quoted with escapes."""
    quoted = text
    for found, put in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        quoted = F.replace(quoted, F.lit(found), F.lit(put))
    return F.when(text.isNull(), F.lit("null")).when(yaml_plain(text), text).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def date_range(first: Column, last: Column) -> Column:
    """Two ISO dates, the second without what it shares with the first."""
    month = F.substring(first, 1, 7) == F.substring(last, 1, 7)
    year = F.substring(first, 1, 4) == F.substring(last, 1, 4)
    short = F.when(month, F.substring(last, 9, 2)).when(year, F.substring(last, 6, 5)).otherwise(last)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(".."), short))


def byte_size(notation: str) -> int:
    """Bytes of a size such as `64K`, `1MB`, `2GiB`: K, M and G are powers of 1024 unless a bare B follows."""
    m = re.fullmatch(r"(\d+)([KMG]*)(IB|B|I|)", notation.upper())
    if not m:
        raise ValueError(f"no size: {notation!r}")
    step = 1000 if m[3] == "B" else 1024
    size = int(m[1])
    for unit in m[2]:
        size *= step ** ("KMG".index(unit) + 1)
    return size


# --- shell words --------------------------------------------------------------------------------------

#: The diagnostics of characters that a shell would interpret.
SHELL_MARKS = {
    "$": "dollar_sign", "`": "backtick", "|": "pipe", "&": "ampersand", ";": "semicolon", "(": "open_paren", ")": "close_paren",
    "<": "less_than", ">": "greater_than", "*": "asterisk", "?": "question_mark", "[": "open_bracket",
}
_SHELL = re.compile(
    rb"""(?P<join>\\\n)|\\(?P<escaped>[\s\S])|(?P<dangling>\\)|'(?P<single>[^']*)(?P<single_end>'|\Z)|(?P<double>")|(?P<gap>[ \t]+)|(?P<line>[\r\n])|(?P<mark>[$`|&;()<>*?\[~#])|(?P<plain>[^\\'" \t\r\n$`|&;()<>*?\[~#]+)""",
    re.DOTALL,
)
_DOUBLE = re.compile(rb"""\\(?P<kept>[$`"\\])|(?P<join>\\\n)|(?P<mark>[$`])|(?P<end>")|(?P<plain>[^\\"$`]+|\\)""", re.DOTALL)


def shell_words(data: bytes) -> tuple[list[bytes], list[tuple[str, int, int]]]:
    """(words, diagnostics (kind, byte, position)) of a command line, by POSIX quoting rules.

    Nothing is expanded: what a shell would interpret stays in its word and is reported. A line break is
    reported and separates words.
    """
    words: list[bytes] = []
    found: list[tuple[str, int, int]] = []
    word, begun, fresh, at = bytearray(), False, True, 0

    def finish():
        nonlocal word, begun, fresh
        if begun or word:
            words.append(bytes(word))
        word, begun, fresh = bytearray(), False, True

    while at < len(data):
        m = _SHELL.match(data, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "gap":
            finish()
        elif kind == "line":
            found.append(("newline", data[start], start))
            finish()
        elif kind == "dangling":
            found.append(("trailing_backslash", data[start], start))
        elif kind == "double":
            begun, fresh, closed = True, False, False
            while at < len(data):
                d = _DOUBLE.match(data, at)
                if d.lastgroup == "mark":
                    found.append((SHELL_MARKS[chr(data[at])], data[at], at))
                if d.lastgroup not in ("join", "end"):
                    word += d[d.lastgroup]
                at = d.end()
                if d.lastgroup == "end":
                    closed = True
                    break
            if not closed:
                found.append(("unclosed_double_quote", data[start], start))
        elif m["single_end"] is not None:
            begun, fresh = True, False
            word += m["single"]
            if not m["single_end"]:
                found.append(("unclosed_single_quote", data[start], start))
        elif kind == "mark":
            mark = chr(data[start])
            if mark in SHELL_MARKS:
                found.append((SHELL_MARKS[mark], data[start], start))
            elif fresh:
                found.append(("tilde" if mark == "~" else "hash", data[start], start))
            word += m[0]
            fresh = False
        elif kind != "join":
            word += m[kind]
            fresh = False
    finish()
    return words, found


_FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("byte", T.IntegerType()), T.StructField("position", T.IntegerType())])
_SPLIT = T.StructType([T.StructField("args", T.ArrayType(T.BinaryType())), T.StructField("errors", T.ArrayType(_FOUND))])


@F.pandas_udf(_SPLIT)
def split_shell(data: pd.Series) -> pd.DataFrame:
    """struct(args, errors) of each command line (binary or string)."""
    rows = []
    for d in data:
        if d is None:
            rows.append((None, None))
            continue
        args, errors = shell_words(d.encode() if isinstance(d, str) else bytes(d))
        rows.append((args, [{"kind": k, "byte": b, "position": p} for k, b, p in errors]))
    return pd.DataFrame(rows, columns=["args", "errors"])
