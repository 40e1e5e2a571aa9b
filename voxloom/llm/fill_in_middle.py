"""Fill-in-middle documents by displacement: every byte of a batch gets its output place from one running sum.

A document is cut into prefix, middle and suffix. In the output each part stands elsewhere, so a part's bytes share one
shift. The shifts of a batch are a difference array with an entry where a part begins; its running sum is the shift of
every byte, a numpy scatter builds all outputs of the batch at once, and a gather by the same sums takes them back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, in_batches, slices

#: The marks before prefix, suffix and middle; a document that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
#: Percent of documents that are cut, and of those the percent that have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
SEED = 42
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: The order of the parts (0 prefix, 1 middle, 2 suffix) in an output.
ORDERS = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARK_OF = (PREFIX, MIDDLE, SUFFIX)
ROWS = 2048
#: Bytes whose shifts are worked out at once.
BLOCK = 1 << 20


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the seed and the id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))


def spread(n: int, places: np.ndarray, steps: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The running sum of a difference array that has `steps` at ordered `places`, block by block."""
    held = 0
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        lo, hi = np.searchsorted(places, (at, to))
        difference = np.zeros(to - at, dtype=np.int64)
        np.add.at(difference, places[lo:hi] - at, steps[lo:hi])
        difference[0] += held
        total = np.cumsum(difference)
        held = total[-1]
        yield slice(at, to), total


def jumps(starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """What the shift changes by at each start."""
    return np.diff(shifts, prepend=0)


class Cuts:
    """The token counts of the texts of a batch and the byte places of cuts, for texts that lie one after the other."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        space = is_space(raw)
        last = np.zeros(len(raw), dtype=bool)  # a token's last byte: of a word, or of the white space at the end
        last[:-1] = ~space[:-1] & space[1:]
        full = ends > starts
        last[ends[full] - 1] = True
        self.stops = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.stops, starts, side="right")
        self.n = np.searchsorted(self.stops, ends, side="right") - self.first
        self.starts = starts

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where each text is cut after k tokens."""
        if not len(self.stops):
            return self.starts
        return np.where(k > 0, self.stops[np.maximum(self.first + k - 1, 0).clip(max=len(self.stops) - 1)], self.starts)


def characters(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points between places; a batch's texts have less than 2^31 bytes."""
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
    return before[hi] - before[lo]


def scatter(raw: np.ndarray, bounds: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch, one after the other, and where each begins (with the end of the last).

    bounds has a row of four places a text: its start, the ends of prefix and middle, its end. Texts lie one after the
    other in raw.
    """
    sizes = np.diff(bounds, axis=1)
    cut = forms != PLAIN
    begins = np.concatenate([[0], np.cumsum(sizes.sum(axis=1) + 9 * cut)])
    shifts = np.repeat((begins[:-1] - bounds[:, 0])[:, None], 3, axis=1)
    out = np.empty(begins[-1], dtype=np.uint8)
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        at = begins[rows].copy()
        for part in order:
            for k, byte in enumerate(MARK_OF[part]):
                out[at + k] = byte
            at += 3
            shifts[rows, part] = at - bounds[rows, part]
            at += sizes[rows, part]
    starts, shifts = bounds[:, :3].ravel(), shifts.ravel()
    for block, shift in spread(len(raw), starts, jumps(starts, shifts)):
        out[np.arange(block.start, block.stop) + shift] = raw[block]
    return out, begins


def gather(out: np.ndarray, begins: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs, one after the other, and where each begins (with the end of the last).

    Only the outputs and their forms are used: the first and the two other marks of a cut output are found again.
    """
    cut = np.flatnonzero(forms != PLAIN)
    sign = np.flatnonzero((out[:-2] == MARKS[0][0]) & (out[2:] == MARKS[0][2])) if len(out) > 2 else np.zeros(0, dtype=np.int64)
    sign = sign[np.isin(out[sign + 1], [m[1] for m in MARKS])]
    owner = np.searchsorted(begins, sign, side="right") - 1
    sign = sign[np.isin(owner, cut)]
    if len(sign) != 3 * len(cut):
        raise ValueError("a cut output has three marks")
    sign = sign.reshape(-1, 3)
    begin, end = begins[:-1], begins[1:]
    # For each text three parts in the order of the text: where they are in the output and their sizes.
    at, sizes = np.repeat(begin[:, None], 3, axis=1), np.zeros((len(forms), 3), dtype=np.int64)
    sizes[:, 0] = end - begin
    size = np.diff(np.concatenate([sign, end[cut, None]], axis=1), axis=1) - 3
    for form, order in ORDERS.items():
        of = forms[cut] == form
        for place, part in enumerate(order):
            at[cut[of], part] = sign[of, place] + 3
            sizes[cut[of], part] = size[of, place]
    back = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())])[:-1]
    raw = np.empty(back[-1], dtype=np.uint8)
    for block, shift in spread(len(raw), starts, jumps(starts, at.ravel() - starts)):
        raw[block] = out[np.arange(block.start, block.stop) + shift]
    return raw, back


def _hashes(raw: np.ndarray, begins: np.ndarray) -> list[str]:
    view = memoryview(raw)
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]


def fill_in_middle(docs: DataFrame, seed: int = SEED, keep_output: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 (and output with keep_output).

    A token is a word with the white space before it, or the white space at the end; n counts them. Null texts are
    empty; empty texts and texts that hold a mark stay plain. Rows are independent: repeated rows come back as often
    as given, null doc_ids draw as an empty id, extra columns are ignored, and an empty table gives no rows. A batch
    takes about ten times its texts; the shifts of a long text are worked out in blocks of BLOCK bytes.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    schema += ", output binary" * keep_output

    def run(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                yield transformed(part)

    def transformed(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
        plain = (starts == ends) | part.column("marked").to_numpy(zero_copy_only=False) | (h3 % 100 >= CUT_PERCENT)
        forms = np.where(plain, PLAIN, np.where(h4 % 100 < SUFFIX_FIRST_PERCENT, SPM, PSM))
        cuts = Cuts(raw, starts, ends)
        one, two = h1 % (cuts.n + 1), h2 % (cuts.n + 1)
        low, high = (np.where(plain, starts, cuts.place(k)) for k in (np.minimum(one, two), np.maximum(one, two)))
        out, begins = scatter(raw, np.stack([starts, low, high, ends], axis=1), forms)
        restored, back = gather(out, begins, forms)
        columns = [
            part.column("doc_id").cast(pa.int64()),
            pa.array(cuts.n),
            pa.array(forms.tolist(), pa.string()),
            pa.array(characters(raw, starts, low), pa.int64(), mask=plain),
            pa.array(characters(raw, low, high), pa.int64(), mask=plain),
            pa.array(_hashes(out, begins), pa.string()),
            pa.array(_hashes(restored, back), pa.string()),
        ]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        if keep_output:
            columns.append(pa.array([bytes(out[a:b]) for a, b in zip(begins[:-1], begins[1:])], pa.binary()))
            names.append("output")
        return pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark.decode()))
    drawn = [h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("doc_id"), seed))]
    return in_batches(docs).select("doc_id", text.alias("text"), marked.alias("marked"), *drawn).mapInArrow(run, schema)


def op13_fill_in_middle(spark, sf_dir):
    return fill_in_middle(documents(spark, sf_dir))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
u AS (
  SELECT *, len(tok) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tok) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(tok) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
v AS (
  SELECT *, array_to_string(tok[1:least(a, b)], '') AS pre, array_to_string(tok[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(tok[greatest(a, b) + 1:], '') AS suf FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
"""
