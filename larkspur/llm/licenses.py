"""License scan by canonical digest: whole texts, normalised and hashed, looked up among known licences.

Built-in expressions only. A text's canonical form has small ASCII letters, no copyright lines, one blank for
every run of punctuation or white space, and one spelling for each of the known variants. Texts and known
licences go through the same expression; equal canonical forms have equal SHA-256 digests and meet in a hash
join on the digest.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that states a copyright: after any marks, the word with a sign, a year, a placeholder or "by", or a sign with a
#: year or a placeholder; "(c)" before other words is a clause's letter.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*([0-9]{4}|[<\[{]|copyright)|©)[^\n]*$"
#: Paragraphs of copyright lines without a sign or a year, as in "Copyright Joyent, Inc. and other contributors."
UNSIGNED = r"(\A|\n[ \t\r]*\n)(([^a-z0-9\n]*copyright[ \t][^\n]*(\n|\z)){1,20}([ \t\r]*(\n|\z))+){1,9}"
#: Quotes, dashes and blanks beyond ASCII and what they stand for; the last ones, without a width, go.
DRESS = "\u201c\u201d\u201e\u201f\u00ab\u00bb\u2018\u2019\u201a\u201b\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u3000\u200b\ufeff\u00ad"
UNDRESSED = '"' * 6 + "'" * 4 + "-" * 7 + " " * 8
#: ASCII that is neither a letter nor a digit.
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Spellings that count as one, as whole words or word beginnings in the blank-separated form.
SPELLINGS = [
    (" licenc", " licens"), (" sub licens", " sublicens"), (" non commercial", " noncommercial"), (" organis", " organiz"), (" authoris", " authoriz"),
    (" favour", " favor"), (" per cent ", " percent "), (" copyright holders ", " copyright holder "), (" copyright owner ", " copyright holder "),
    (" merchantability ", " merchantibility "), (" all rights reserved ", " "), (" https ", " http "),
]

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Short licences and notices by name.
SHORT = {
    "MIT": [f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"],
    "MIT-0": [f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_END}", f"{_MIT_GRANT}.\n\n{_MIT_END}"],
    "ISC": [f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"],
    "0BSD": [f"{_ISC_GRANT}.\n\n{_ISC_END}"],
    "BSD-2-Clause": [f"BSD 2-Clause License\n\n{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n\n{_BSD_END}", f"{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n\n{_BSD_END}"],
    "BSD-3-Clause": [f"BSD 3-Clause License\n\n{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n\n{_BSD_END}", f"{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n\n{_BSD_END}"],
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0 notice": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0 notice": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0 notice": ["Licensed under CC BY 4.0."],
}


def known_texts() -> dict[str, list[str]]:
    """SHORT, further titles of MIT, and the full texts in license_texts: each whole, and without what follows its terms."""
    out = SHORT | {"MIT": [*SHORT["MIT"], *[f"{title}\n\n{SHORT['MIT'][1]}" for title in ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)")]]}
    for file in sorted(files("larkspur.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text, end = file.read_text("utf-8"), "END OF TERMS AND CONDITIONS"
            terms = text.split(end)[0] if end in text else text
            out[file.name[:-4]] = [text, terms + end, terms] if end in text else [text]
    return out


#: Known licences and notices by name. Callers may pass their own.
KNOWN = known_texts()


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    out = F.translate(text, UPPER + DRESS, LOWER + UNDRESSED)
    out = F.regexp_replace(out, COPYRIGHT, " ")
    out = F.regexp_replace(out, UNSIGNED, "\n\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, MARKS, " "), F.lit(" "))
    out = F.regexp_replace(out, "  +", " ")
    for found, put in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(put))
    return F.trim(out)


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license): one row for each different digest, the first name by code point."""
    pairs = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, texts in (known or KNOWN).items() for text in texts]
    listed = spark.range(1).select(F.explode(F.array(*pairs)).alias("k"))
    return listed.select(F.sha2(canonical(F.col("k.text")), 256).alias("digest"), "k.license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, digest, license of every row; license is null for texts that are no known licence.

    The whole text must be the licence. A null text has a null digest and no licence; texts that are
    empty or hold only copyright lines and marks share the digest of the empty text and have none.
    Repeated rows stay repeated. The table of known digests is as large as `known`, and broadcast.
    """
    texts = docs.select("doc_id", F.sha2(canonical(F.col("text").cast("string")), 256).alias("digest"))
    return texts.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left").select("doc_id", "digest", "license")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, {_sql_string(UPPER + DRESS)}, {_sql_string(LOWER + UNDRESSED)}), '{COPYRIGHT}', ' ', 'g')"
    out = f"regexp_replace({out}, '{UNSIGNED}', chr(10) || chr(10), 'g')"
    out = f"regexp_replace(' ' || regexp_replace({out}, '{MARKS}', ' ', 'g') || ' ', '  +', ' ', 'g')"
    for found, put in SPELLINGS:
        out = f"replace({out}, '{found}', '{put}')"
    return f"trim({out})"


_VALUES = ", ".join(f"({_sql_string(name)}, {_sql_string(text)})" for name, texts in KNOWN.items() for text in texts)
QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE = {
    "op3_license_scan": f"""
WITH k AS (SELECT sha256({_sql_canonical("body")}) AS digest, min(license) AS license FROM (VALUES {_VALUES}) v(license, body) GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license FROM d LEFT JOIN k ON d.digest = k.digest"""
}
