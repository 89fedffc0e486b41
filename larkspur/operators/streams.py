"""Ordered item streams: rows (stream_id, seq, kind, text, bytes, err), in order of seq within a stream.

`kind` is text, bytes or value; a row with err is an error item. Operators that split work over the stream's
concatenation, so a segment may begin in one item and end in another; a change of kind, a value and an error
flush what is pending, and values and errors pass. Items are cut where they lie and only the pieces that touch
an item's ends are put together, by a key that counts the cuts before them: no stream is ever concatenated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[ \t\n\f\r]"
ITEM = "stream_id long, seq long, kind string, text string, bytes binary, err string"

def _order():
    return Window.partitionBy("stream_id").orderBy("seq")


def text_items(df: DataFrame, stream: str, seq: str, text: str) -> DataFrame:
    """Items of a table of texts."""
    none = F.lit(None)
    return df.select(
        F.col(stream).cast("long").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.lit("text").alias("kind"), F.col(text).alias("text"),
        none.cast("binary").alias("bytes"), none.cast("string").alias("err"),
    )


def flushed(items: DataFrame) -> DataFrame:
    """items with run: rows of one run are contiguous and of one kind; values and errors have their own."""
    plain = _plain()
    label = F.when(plain, F.col("kind"))
    breaks = F.when(label.isNull() | ~label.eqNullSafe(F.lag(label).over(_order())), 1).otherwise(0)
    return items.withColumn("run", F.sum(breaks).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def _renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """Items numbered anew from 0 in each stream."""
    place = Window.partitionBy("stream_id").orderBy(*order)
    return rows.withColumn("seq", F.row_number().over(place).cast("long") - 1).select("stream_id", "seq", "kind", "text", "bytes", "err")


def _stitched(items: DataFrame, pieces, around: int = 0) -> DataFrame:
    """Put pieces together: all but the last piece of an item end a segment, the last stays open.

    `pieces` makes a string array of at least one piece, the last maybe empty, of an item's text. Bytes go the same way
    as texts of one character a byte. With `around`, pieces gets the item with so many characters that come before
    it in its run, and how many there were.
    """
    rows = flushed(items)
    chars = F.when(F.col("kind") == "text", F.col("text")).otherwise(F.decode("bytes", "ISO-8859-1"))
    run = Window.partitionBy("stream_id", "run", "kind").orderBy("seq")
    cut = rows.where(_plain()).withColumn("__t", chars).where("__t <> ''")
    if around:
        lead = F.array_join(F.collect_list(F.right("__t", F.lit(around))).over(run.rowsBetween(-around, -1)), "")
        cut = cut.withColumn("__lead", F.right(lead, F.lit(around)))
        found = pieces(F.concat("__lead", "__t"))
        first = F.substring(F.get(found, F.lit(0)), F.length("__lead") + 1, F.length(F.get(found, F.lit(0))))
        cut = cut.withColumn("__p", F.concat(F.array(first), F.slice(found, F.lit(2), F.size(found))))
    else:
        cut = cut.withColumn("__p", pieces(F.col("__t")))
    cut = cut.withColumn("__ends", F.size("__p") - 1)
    cut = cut.withColumn("__before", F.coalesce(F.sum("__ends").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = cut.select("stream_id", "run", "kind", "seq", F.col("__before"), F.posexplode("__p").alias("__k", "__piece"))
    joined = each.groupBy("stream_id", "run", "kind", (F.col("__before") + F.col("__k")).alias("segment")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("seq", "__piece")))["__piece"], "").alias("t")
    )
    return _as_items(joined.where(F.col("t") != ""))


def _as_items(found: DataFrame) -> DataFrame:
    """Segments t of texts, or of bytes as one character each, as items."""
    is_text = F.col("kind") == "text"
    return found.select(
        "stream_id", "run", "segment", "kind", F.when(is_text, F.col("t")).alias("text"),
        F.when(~is_text, F.encode(F.when(~is_text, F.col("t")), "ISO-8859-1")).alias("bytes"), F.lit(None).cast("string").alias("err"),
    )


def _plain() -> Column:
    return F.col("err").isNull() & F.col("kind").isin("text", "bytes")


def _others(items: DataFrame) -> DataFrame:
    return flushed(items).where(~_plain()).select("stream_id", "run", F.col("seq").alias("segment"), "kind", "text", "bytes", "err")


def lines(items: DataFrame) -> DataFrame:
    """Texts and bytes cut after every line break; the break stays. Values and errors pass."""
    return split_after(items, "\n")


def words(items: DataFrame) -> DataFrame:
    """Runs of characters, or bytes, that are no ASCII white space, across items. Values and errors pass."""
    found = _stitched(items, lambda t: F.split(F.regexp_replace(t, f"{SPACE}+", "\n"), "(?<=\n)"))
    bare = F.rtrim(F.translate(F.coalesce("text", F.decode("bytes", "ISO-8859-1")), "\n", " "))
    found = _as_items(found.select("stream_id", "run", "segment", "kind", bare.alias("t")).where("t <> ''"))
    return _renumbered(found.unionByName(_others(items)), "run", "segment")


def chunks(items: DataFrame, size: int) -> DataFrame:
    """Text in chunks of so many characters and bytes in chunks of so many bytes; 0 means 65536."""
    size = size or 65536
    rows = flushed(items)
    plain = _plain()
    run = Window.partitionBy("stream_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    length = F.when(F.col("kind") == "text", F.char_length("text")).otherwise(F.octet_length("bytes")).cast("long")
    cut = rows.where(plain).withColumn("__n", length).withColumn("__at", F.coalesce(F.sum("__n").over(run), F.lit(0))).where("__n > 0")
    spans = F.sequence(F.expr(f"__at div {size}"), F.expr(f"(__at + __n - 1) div {size}"))
    each = cut.withColumn("segment", F.explode(spans))
    start = F.greatest(F.col("segment") * size - F.col("__at"), F.lit(0)).cast("int")
    count = (F.least((F.col("segment") + 1) * size - F.col("__at"), F.col("__n")) - start).cast("int")
    piece = F.struct("seq", F.substring("text", start + 1, count).alias("t"), F.hex(F.substring("bytes", start + 1, count)).alias("b"))
    joined = each.groupBy("stream_id", "run", "segment", "kind").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    whole = joined.select(
        "stream_id", "run", "segment", "kind", F.when(F.col("kind") == "text", F.array_join("p.t", "")).alias("text"),
        F.when(F.col("kind") == "bytes", F.unhex(F.array_join("p.b", ""))).alias("bytes"), F.lit(None).cast("string").alias("err"),
    )
    rest = rows.where(~plain).select("stream_id", "run", F.col("seq").alias("segment"), "kind", "text", "bytes", "err")
    return _renumbered(whole.unionByName(rest), "run", "segment")


def split_after(items: DataFrame, pattern: str) -> DataFrame:
    """Texts and bytes cut after every occurrence of a literal pattern, also of one that lies across items.

    Occurrences of a pattern whose beginning is not its end cannot overlap: each item is cut where it lies, with as many
    characters before it as the pattern could begin in. A pattern that can overlap itself is found from left to
    right, which an Arrow UDF does over a stream's run as one string.
    """
    import re

    if not any(pattern.startswith(pattern[-k:]) for k in range(1, len(pattern))):
        wide = pattern.encode().decode("latin-1")  # in bytes the pattern is its UTF-8 form
        after = lambda t, p: F.split(t, f"(?<={re.escape(p)})")
        found = _stitched(items, lambda t: F.when(F.col("kind") == "text", after(t, pattern)).otherwise(after(t, wide)), len(wide) - 1)
        return _renumbered(found.unionByName(_others(items)), "run", "segment")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        forms = {"text": pattern, "bytes": pattern.encode().decode("latin-1")}
        return pd.Series([_scan(t, forms[k]) for t, k in zip(texts, kinds, strict=True)])

    chars = F.when(F.col("kind") == "text", F.col("text")).otherwise(F.decode("bytes", "ISO-8859-1"))
    runs = flushed(items).where(_plain()).withColumn("__t", chars).groupBy("stream_id", "run", "kind")
    whole = runs.agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "__t")))["__t"], "").alias("t"))
    cut = _as_items(whole.select("stream_id", "run", "kind", F.posexplode(scan("t", "kind")).alias("segment", "t")).withColumn("segment", F.col("segment").cast("long")))
    return _renumbered(cut.unionByName(_others(items)), "run", "segment")


def _scan(text: str, pattern: str) -> list[str]:
    out, at = [], 0
    while (hit := text.find(pattern, at)) >= 0:
        out.append(text[at : hit + len(pattern)])
        at = hit + len(pattern)
    return [*out, text[at:]] if at < len(text) else out


# --- one item at a time -----------------------------------------------------------------------------------


def without_empty(items: DataFrame) -> DataFrame:
    """Drops empty texts and bytes; errors and values pass."""
    size = F.coalesce(F.length("text"), F.octet_length("bytes"), F.lit(0))
    return items.where(F.col("err").isNotNull() | (F.col("kind") == "value") | (size > 0))


def containing(items: DataFrame, part: str) -> DataFrame:
    return items.where(F.contains("text", F.lit(part)) | F.contains("bytes", F.lit(part.encode())))


def oks(items: DataFrame) -> DataFrame:
    return items.where("err is null")


def errs(items: DataFrame) -> DataFrame:
    return items.where("err is not null")


def oks_and_errs(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a stream; persist `items` first where computing them twice costs more than keeping them."""
    return oks(items), errs(items)


def checked(items: DataFrame) -> DataFrame:
    """The items; the job fails at an error item with its message."""
    return items.withColumn("err", F.when(F.col("err").isNotNull(), F.raise_error(F.col("err")).cast("string")))


def fail_fast(items: DataFrame) -> DataFrame:
    """Each stream up to its first error, without it: one pass to find it, one to filter."""
    first = items.where("err is not null").groupBy("stream_id").agg(F.min("seq").alias("__stop"))
    return items.join(first, "stream_id", "left").where(F.col("__stop").isNull() | (F.col("seq") < F.col("__stop"))).drop("__stop")


def first(items: DataFrame, n: int = 1) -> DataFrame:
    place = F.row_number().over(_order())
    return items.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def last(items: DataFrame, n: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return items.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def joined(items: DataFrame, between: str = "", after: str = "") -> DataFrame:
    """(stream_id, text, bytes): all texts and bytes of a stream in order, with a string between them or after each.

    A stream with an item of bytes is joined as bytes, texts in UTF-8, and has no text; another has no bytes.
    """
    part = F.hex(F.coalesce("bytes", F.encode("text", "UTF-8")))
    listed = items.where("err is null and kind <> 'value'").groupBy("stream_id").agg(
        F.max(F.col("kind") == "bytes").alias("raw"), F.sort_array(F.collect_list(F.struct("seq", F.concat("text", F.lit(after)).alias("t"), F.concat(part, F.lit(after.encode().hex())).alias("h")))).alias("p")
    )
    return listed.select(
        "stream_id", F.when(~F.col("raw"), F.array_join("p.t", between)).alias("text"), F.when(F.col("raw"), F.unhex(F.array_join("p.h", between.encode().hex()))).alias("bytes")
    )


# --- command lines ------------------------------------------------------------------------------------------

ALIASES = {"to-mixed85-lines": ["encode-mixed85", "split-80", "join-lines"]}


def commands(arguments: list[str]) -> list[str]:
    """Arguments split at ` | `, with aliases expanded."""
    import re

    out: list[str] = []
    for a in arguments:
        for c in [p.strip() for p in a.split("|")] if re.search(r"\s\|\s", a) else [a]:
            out += ALIASES.get(c, [c])
    return out


def pipeline(items: DataFrame, arguments: list[str]) -> DataFrame:
    """Run text commands over items: split-lines, split-whitespace, split-N, filter,
    find-X, collapse, first[-N], last[-N], join, join-lines, join-space, encode-mixed85, to-hex, parse-hex, to-binary, parse-binary.

    Unknown commands raise ValueError; arguments with `=` are ignored.
    """
    from larkspur.functions import codecs
    from larkspur.functions import text as text_functions
    from larkspur.functions.text import byte_size

    none = F.lit(None)
    again = lambda df: df.select("stream_id", F.lit(0).cast("long").alias("seq"), F.when(F.col("bytes").isNull(), "text").otherwise("bytes").alias("kind"), "text", "bytes", none.cast("string").alias("err"))
    data = F.coalesce("bytes", F.encode("text", "UTF-8"))
    for c in commands(arguments):
        name, _, value = c.partition("-")
        if "=" in c:
            continue
        if c == "split-lines":
            items = lines(items)
        elif c == "split-whitespace":
            items = words(items)
        elif c == "filter":
            items = without_empty(items)
        elif c == "collapse":
            items = items.withColumn("text", text_functions.collapse(F.col("text")))
        elif c == "to-binary":
            items = items.withColumn("text", codecs.to_binary_digits(data)).withColumn("bytes", none.cast("binary")).withColumn("kind", F.lit("text"))
        elif c in ("parse-hex", "parse-binary"):
            parse = codecs.parse_hex if c == "parse-hex" else codecs.parse_binary_digits
            read = items.withColumn("__r", parse(F.coalesce("text", F.decode("bytes", "ISO-8859-1"))))
            items = read.withColumns({"bytes": F.col("__r.value"), "err": F.coalesce("err", "__r.error"), "text": none.cast("string"), "kind": F.lit("bytes")}).drop("__r")
        elif name == "split" and value[:1].isdigit():
            items = chunks(items, byte_size(value))
        elif name == "find":
            items = containing(items, value)
        elif name in ("first", "last") and (not value or value.isdigit()):
            items = (first if name == "first" else last)(items, int(value or 1))
        elif c in ("join", "join-lines", "join-space"):
            items = again(joined(items, " " if c == "join-space" else "", "\n" if c == "join-lines" else ""))
        elif c == "encode-mixed85":
            items = items.withColumn("text", codecs.mixed85(data)).withColumn("bytes", none.cast("binary")).withColumn("kind", F.lit("text"))
        elif c == "to-hex":
            items = items.withColumn("text", codecs.to_hex(data)).withColumn("bytes", none.cast("binary")).withColumn("kind", F.lit("text"))
        else:
            raise ValueError(f"unknown command: {c}")
    return items
