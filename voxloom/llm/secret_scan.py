"""Secret scans: fixed patterns, and random strings that a tokenizer vocabulary packs badly."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCH, documents, in_batches, slices, text_slices

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "random"]
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Runs of RUN_MIN key characters and more are tested, in the parts that base spans leave of them; dots stand inside.
RUN_MIN = 8
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
PART, PART_MIN = re.compile(r"[A-Za-z0-9]+"), 4  # shorter parts are those of versions and numbered names
#: A run is random when its characters a token are no more than for LIKELY of random strings of its letters and length
#: under the vocabulary. Letters of one case are tested from ONE_CASE_MIN on, with a lower limit below ONE_CASE_SURE: they
#: are not well told from rare words, and shorter ones not at all.
LIKELY, ONE_CASE_MIN, ONE_CASE_SURE, ONE_CASE_LIMIT, SIMULATED, SEED = 0.95, 16, 20, 1.7, 500, 7
LENGTHS = (8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24, 28, 32, 40, 48, 64)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Digests (MD5, SHA-1, SHA-2) and UUIDs are names of known things, not secrets.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"
)
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
ROWS = 256


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; leftmost, without overlap within a kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS) or "ſ" in text or "K" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Greedy runs of 32 and more are the runs of the base pattern that are long enough.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def letters_of(run: str) -> str | None:
    """The letters that a run is made of, as far as it is worth a test.

    With digits where some part between marks has both letters and digits; of both cases where a part has a capital
    beyond its first letter and small ones; parts under PART_MIN do not count. What is left are words of one case, if there are letters at all.
    """
    parts = [x for x in PART.findall(run) if len(x) >= PART_MIN]
    digits = any(not x.isalpha() and not x.isdigit() for x in parts)
    cases = any(not x[1:].islower() and not x.isupper() and x[1:].lower() != x[1:] for x in parts)
    if digits:
        return DIGITS + (LOWER if any(map(str.islower, run)) else "") + (UPPER if any(map(str.isupper, run)) else "")
    if cases:
        return LOWER + UPPER
    if len(run) < ONE_CASE_MIN or not any(map(str.isalpha, run)):
        return None
    return UPPER if run.isupper() else LOWER


@lru_cache(maxsize=256)
def limit(enc: tiktoken.Encoding, letters: str, length: int) -> float:
    """Characters a token that LIKELY of random strings do not exceed."""
    rng = random.Random(f"{SEED}:{letters}:{length}")
    drawn = ("".join(rng.choices(letters, k=length)) for _ in range(SIMULATED))
    return sorted(length / len(enc.encode_ordinary(x)) for x in drawn)[int(LIKELY * SIMULATED) - 1]


def is_random(run: str, enc: tiktoken.Encoding) -> bool:
    """Whether a run has as few characters a token as random strings; known digests and identifiers have no say."""
    letters = letters_of(run)
    if letters is None or KNOWN.fullmatch(run.strip("+/_=.-")):
        return False
    most = limit(enc, letters, LENGTHS[bisect_right(LENGTHS, len(run)) - 1])
    if letters in (LOWER, UPPER) and len(run) < ONE_CASE_SURE:
        most = min(most, ONE_CASE_LIMIT)
    return len(run) <= most * len(enc.encode_ordinary(run))


def random_spans(text: str, base: list[tuple[int, int, int]], enc: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """Random strings among what base spans (in order) leave of the runs. The name in an address is no secret."""
    out, k, reach = [], 0, 0  # base spans before the k-th start before the run; they end at reach at the latest
    for m in RUN.finditer(text):
        at, end = m.span()
        if end - at < RUN_MIN or text[end : end + 1] == "@":
            continue
        while k < len(base) and base[k][0] <= at:
            reach = max(reach, base[k][2])
            k += 1
        at, j = max(at, reach), k
        while at < end:
            stop = base[j][0] if j < len(base) and base[j][0] < end else end
            if stop - at >= RUN_MIN and is_random(text[at:stop], enc):
                out.append((at, 3, stop))
            if stop == end:
                break
            at, j = max(stop, base[j][2]), j + 1
            while j < len(base) and base[j][0] <= at:
                at, j = max(at, base[j][2]), j + 1
    return out


def all_spans(text: str | None, enc: tiktoken.Encoding) -> tuple[list, list]:
    """The base spans, and all spans by start and kind."""
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, enc))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each secret replaced by the name of its kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, vocabulary: str, mask: bool = False) -> DataFrame:
    """Secrets of each row: counts, digest of the base spans, all spans (and the masked text with mask).

    Spans are code points, end exclusive, by start and then by kind. Null and empty texts have none; with mask a
    null text stays null. Rows are independent: repeated rows and null doc_ids come back as given, an empty table
    gives no rows, and extra columns are ignored.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"] + ["masked"] * mask
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", masked string" * mask

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, ROWS):
                rows = []
                for text in part.column("text").to_pylist():
                    base, spans = all_spans(text, enc)
                    kinds = [k for _, k, _ in spans]
                    rows.append([*(kinds.count(i) for i in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)] + [text and masked(text, spans)] * mask)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64())]
                    + [pa.array(c, pa.int64()) for c in columns[:4]]
                    + [pa.array(c, pa.string()) for c in columns[4:]],
                    names=names,
                )

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with the secrets in text masked and n_chars, if there is one, counted anew; no row is dropped."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        enc, out = encoding(vocabulary), []
        for part in text_slices(texts, ROWS):
            out += [text and masked(text, all_spans(text, enc)[1]) for text in part]
        return pa.array(out, pa.string())

    out = in_batches(docs, SMALL_BATCH).withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secret_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
