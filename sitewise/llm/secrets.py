"""Secrets in texts: fixed patterns, and random strings given away by few characters per token."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.packing import PATTERN

KINDS = ("assign", "access", "hex", "random")  # in the order of equal starts; the first three are the base kinds
# The base patterns. A run of hex digits or of access-key letters is matched whole or not at all, so
# asking for its least length at once finds the same matches; an assignment that fails still uses up its text.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGNED = 12  # characters of an assigned value
# Lengths in hex digits of common digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))


@dataclass(frozen=True)
class Randomness:
    """shortest: characters of a run that is tested; most: characters per token, at most, of a random string."""

    shortest: int = 20
    most: float = 2.2


def load_tiktoken(vocabulary: bytes):
    """An encoder from the lines of a public .tiktoken file: a token in base64 and its rank."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Digests, UUIDs, numbers, and names: parts of letters, each with a number after it at most, or numbers."""
    if len(run) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
        return True
    if re.fullmatch("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", run):
        return True
    # A part of many letters, of one case after the first, is a word or a chain of them (camelCase).
    return all(re.fullmatch("([A-Z]*[a-z]*|([A-Z][a-z]+)+|[a-z]+([A-Z][a-z]+)*)[0-9]*", part) for part in re.split("[+/_=-]+", run))


def find_secrets(docs: DataFrame, vocabulary_path: str, rule: Randomness = Randomness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and spans, an array of (kind, start, end, ratio) in code points, end exclusive.

    Base kinds match leftmost and without overlap, each kind by itself; all of their spans are kept. A
    run of at least rule.shortest characters of `[A-Za-z0-9+/_=-]` is random if it has a letter and a
    digit, is no digest or identifier, has at most rule.most characters per token and does not lie
    inside a base span; ratio is its characters per token. Spans are in order of start, then kind.
    Null and empty texts have none, texts are read whole, repeated rows and null ids stay, other
    columns are ignored, an empty table gives no rows.

    A compiled automaton over each Arrow batch rules out, kind by kind, the texts without a match;
    only the others are searched in Python. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with open(vocabulary_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, about 1 MB
    long_run = f"[A-Za-z0-9+/_=-]{{{rule.shortest},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, access, digits, runs = (re.compile(p) for p in (f"(?ai:{ASSIGN})", ACCESS, HEX, long_run))
        encoding = None
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            found: list[list[tuple[int, int, int, float | None]]] = [[] for _ in range(batch.num_rows)]

            def those(pattern: str, ignore_case: bool = False, texts: pa.Array = texts) -> list[tuple[int, str]]:
                rows = pc.indices_nonzero(pc.match_substring_regex(texts, pattern, ignore_case=ignore_case))
                return list(zip(rows.to_pylist(), texts.take(rows).to_pylist(), strict=True))

            for row, text in those(ASSIGN.replace("\\x20", " "), True):
                found[row] += [(0, *m.span(), None) for m in assign.finditer(text) if len(m[2]) >= ASSIGNED]
            for which, pattern in ((1, access), (2, digits)):
                for row, text in those(pattern.pattern):
                    found[row] += [(which, *m.span(), None) for m in pattern.finditer(text)]
            for row, text in those(long_run):
                base = [(a, b) for _, a, b, _ in found[row]]
                for m in runs.finditer(text):
                    letters = re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])
                    if not letters or is_identifier(m[0]) or any(a <= m.start() and m.end() <= b for a, b in base):
                        continue
                    encoding = encoding or load_tiktoken(shared.value)
                    ratio = len(m[0]) / len(encoding.encode_ordinary(m[0]))
                    if ratio <= rule.most:
                        found[row].append((3, *m.span(), ratio))
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "ratio": r} for k, a, b, r in sorted(x, key=lambda s: (s[1], s[0]))] for x in found]
            one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(one))], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,ratio:double>>")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, counts of the base kinds, sha256 of the base spans' text, and the text of all spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != KINDS[-1])
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:-1]]
    return found.select(id_col, *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"))
