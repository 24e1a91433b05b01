"""Secret scan by dictionary-primed zstandard novelty (operator 9).

Fixed patterns give base spans. The method adds spans of kind ``novel``: strings
of ``SHORTEST`` or more characters of the secret alphabet, with letters, that
follow a sensitive word within ``REACH`` characters and overlap no base span. For
each, the text around it is compressed with and without it, by a compressor
primed with identifiers of the corpus; if the string costs about what a random
one of its own alphabet must (``asked``) it is incompressible there and is
reported.

The identifier dictionary is counted over all documents that hold a sensitive
word: tokens of letters and underscores, by the number of distinct texts, the
``IDENTIFIERS`` most frequent (a fixed bound on what reaches the driver). Only
whole tokens between characters outside the secret alphabet count, too short to
be a candidate, so that no copied secret primes its own compressor.

Spans are in code points, end exclusive, of the whole match. Defined results:
a null text counts as empty and has no span; repeated rows get equal spans; very
long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 and more; shorter runs are no matches
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Words after which a string may be a secret.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access_key", "session", "signature")
SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
CONTEXT = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORTEST = 16
# A whole token too short to be a candidate: no piece of one.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])([A-Za-z_]{4,%d})(?![A-Za-z0-9+/_=-])" % (SHORTEST - 1)
CAPITAL_HEX, SMALL_HEX = frozenset("0123456789ABCDEF"), frozenset("0123456789abcdef")
REACH = 48
AROUND = 512
PRICE = 0.78  # a string this dear, in bytes a character, is reported whatever its alphabet
SHARE = 0.95  # of the entropy of the candidate's alphabet
ROUNDING = 1.0  # bytes; frames are whole bytes, and the candidate changes the code of its surroundings
SAMPLED = 128  # a string this long shows all symbols of its alphabet
IDENTIFIERS = 2_000


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted by start, then kind."""
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    found: list[tuple[int, int, int]] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def alphabet(candidate: str) -> int:
    """Number of symbols a random string of this kind is drawn from."""
    kinds = set(candidate)
    if len(candidate) >= SAMPLED:
        return len(kinds)
    if kinds <= CAPITAL_HEX or kinds <= SMALL_HEX:
        return 16
    size = sum(n for n, some in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(some, kinds)))
    return size + sum(not c.isalnum() for c in kinds)


def asked(candidate: str) -> float:
    """Bytes per character from which a candidate is incompressible."""
    return min(PRICE, SHARE * math.log2(alphabet(candidate)) / 8 - ROUNDING / len(candidate))


class Novelty:
    """Marginal compressed size against a text and a dictionary of identifiers."""

    def __init__(self, identifiers: tuple[str, ...]) -> None:
        import zstandard

        # The most frequent come last, nearest to what is compressed.
        primed = "\n".join(reversed(identifiers)).encode()
        options = {"dict_data": zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(primed) >= 8 else {}
        self.compressor = zstandard.ZstdCompressor(level=19, write_content_size=False, **options)

    def price(self, before: str, candidate: str, after: str) -> float:
        """Bytes per character that the candidate adds to its surroundings."""
        rest = len(self.compressor.compress((before + after).encode("utf-8", "replace")))
        whole = len(self.compressor.compress((before + candidate + after).encode("utf-8", "replace")))
        return (whole - rest) / len(candidate)


@lru_cache(maxsize=2)
def _novelty(identifiers: tuple[str, ...]) -> Novelty:
    return Novelty(identifiers)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, low: bytes) -> list[tuple[int, int, int]]:
    if not any(w in low for w in SENSITIVE_BYTES):
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if e - s < SHORTEST or not any(c.isalpha() for c in m[0]):
            continue
        if any(a < e and s < b for a, _, b in base) or not CONTEXT.search(text, max(0, s - REACH), s):
            continue
        if novelty.price(text[max(0, s - AROUND) : s], m[0], text[e : e + AROUND]) >= asked(m[0]):
            found.append((s, 3, e))
    return found


def identifier_dictionary(docs: DataFrame, size: int = IDENTIFIERS) -> tuple[str, ...]:
    """Identifiers of the documents with a sensitive word, most frequent first."""
    pattern = "(?i)" + "|".join(SENSITIVE)
    texts = docs.where(F.col("text").rlike(pattern)).select(F.xxhash64("text").alias("body"), "text")
    words = texts.select("body", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER)))).alias("word"))
    counts = words.distinct().groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return tuple(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect())


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, identifiers: tuple[str, ...]) -> DataFrame:
    """Spans of every row of ``docs`` (``doc_id``, ``text``)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = _novelty(identifiers)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                low = text.encode("utf-8", "surrogatepass").lower()
                base = base_spans(text, low)
                kinds = [k for _, k, _ in base]
                every = base + novel_spans(text, base, novelty, low)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy() if batch["doc_id"].hasnans else batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, identifier_dictionary(docs))
