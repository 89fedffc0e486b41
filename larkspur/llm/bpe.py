"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the pre-splitting pattern has a match boundary whatever stands around it: before a single space
between two letters or digits of any script, and between a letter and a mark of another script's sentences that follows
it. Very long runs of white space, where the pattern backtracks, are cut by the pattern's own rule. Both hold for
the default pattern only; with another one a text is matched whole. The ids are those of the uncut text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import byte_values, table

#: Texts are cut into pieces of about this many characters, at safe boundaries only.
PIECE = 1 << 16
#: Runs of white space from this length on are matched here, not by the library's pattern.
RUN = 1 << 12
_SAFE = re.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])|(?<=\p{L})(?=[。，、；：？！…「」『』（）《》।॥،؟۔])")
#: White space as the library's pattern has it (Unicode White_Space).
_RUN = re.compile("[\t-\r \x85\xa0  -     　]{%d,}" % RUN)


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


@cache
def encoding(path: str, pattern: str):
    """The encoder of a rank file, loaded once in each Python process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE):
    """text in order, cut only at certain match boundaries, in pieces of about limit characters."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc, text: str) -> np.ndarray:
    """The ids of text as little-endian unsigned 32-bit integers, without special tokens."""
    if len(text) <= RUN or enc._pat_str != public_tokenizers.PATTERN:
        return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u4", copy=False)
    out, start = [], 0
    # `\\s+(?!\\S)` takes a run but for its last character if anything follows, else all of it
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [encode_plain(enc, p) for p in safe_pieces(text[start : m.start()])]
        out.append(np.array(enc._encode_single_piece(text[m.start() : end]), "<u4"))
        start = end
    out += [encode_plain(enc, p) for p in safe_pieces(text[start:])]
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def encode_plain(enc, text: str) -> np.ndarray:
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u4", copy=False)


def decode(enc, ids: np.ndarray) -> bytes:
    return b"".join(enc.decode_bytes(ids[at : at + PIECE].tolist()) for at in range(0, len(ids), PIECE))


def _mapped(docs: DataFrame, extra: list[tuple[str, str]], work, path: str | None, pattern: str, keep: list[str]) -> DataFrame:
    import pyarrow as pa

    docs = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        enc = encoding(path or rank_file(), pattern)  # a worker has its own copy of the default file
        for b in batches:
            for s in range(0, max(b.num_rows, 1), 1000):
                part = b.slice(s, 1000)
                rows = [work(enc, (t or b"").decode("utf-8", "replace")) for t in byte_values(part.column(part.num_columns - 1))]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *(n for n, _ in extra)])

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = [kinds[t] for _, t in extra]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes[:-1], *extra])
    return docs.mapInArrow(run, schema)


def tokenize(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; a null text has no ids."""
    return _mapped(docs, [("ids", "array<int>")], lambda enc, t: (encode(enc, t).astype(np.int32),), path, pattern, ["doc_id"])


def token_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass.

    Null texts count as empty: no tokens, and the digests of no bytes. Repeated rows stay repeated.
    """

    def work(enc, text):
        ids = encode(enc, text)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()

    return _mapped(docs, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], work, path, pattern, ["doc_id"])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLE: dict[str, str] = {}
