"""Fill-in-middle: displacement scatter of line-cut texts, and its inverse.

The texts of an Arrow batch are one buffer of bytes.  Two cuts a document part it into prefix,
middle and suffix, and each part moves by a constant number of bytes.  The moves are written as
differences at the parts' starts; their cumulative sum gives every byte its output place, and one
numpy scatter builds all outputs.  The inverse reads the markers of the outputs, forms the same kind
of differences for the way back, and one gather restores the texts.  Buffers are taken a few MB at a
time (a longer text alone), and the sums run in windows with a carry, so that little is held beside the
texts themselves.  There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.llm.common import small_batches

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: The marker letters in the order in which an output has them.
ORDER = {"psm": b"PSM", "spm": b"SPM"}

#: Bytes of text handled at once, and of the window of a cumulative sum.
PART, WINDOW = 1 << 22, 1 << 20


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of an array of strings without nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)).cast(pa.string())


def _parts(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART bytes of column ``name``, one row at least."""
    _, at = _bytes(batch.column(name))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PART, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _shifts(starts: np.ndarray, moves: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows of 0..n-1 and the move of each place in them.  ``starts``: ascending starts of runs
    (empty runs allowed), ``moves``: the move of each run."""
    steps = np.diff(moves, prepend=0)
    carry = 0
    for lo in range(0, n, WINDOW):
        hi = min(n, lo + WINDOW)
        a, b = np.searchsorted(starts, [lo, hi])
        change = np.zeros(hi - lo, np.int64)
        np.add.at(change, starts[a:b] - lo, steps[a:b])
        change[0] += carry
        out = np.cumsum(change)
        carry = out[-1]
        yield slice(lo, hi), out


def scatter(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, out: np.ndarray) -> None:
    """out[i + move of i] = data[i] for all i."""
    for window, shift in _shifts(starts, moves, len(data)):
        out[np.arange(window.start, window.stop) + shift] = data[window]


def gather(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """data[i + move of i] for i in 0..n-1."""
    out = np.empty(n, np.uint8)
    for window, shift in _shifts(starts, moves, n):
        out[window] = data[np.arange(window.start, window.stop) + shift]
    return out


def _marks(data: np.ndarray) -> np.ndarray:
    """Places of the three markers."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]))
    return at[np.isin(data[at + 1], np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8))]


def _holds_mark(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents hold a marker in their text."""
    marks = _marks(data)
    doc = np.searchsorted(at, marks, side="right") - 1
    doc = doc[marks + MARK <= at[doc + 1]]  # not one that two texts make together
    out = np.zeros(len(at) - 1, bool)
    out[doc] = True
    return out


class Cuts:
    """Lines of each document and the byte after each number of them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.ends, self.at = np.flatnonzero(data == 10), at
        self.first = np.searchsorted(self.ends, at[:-1])
        self.closed = np.searchsorted(self.ends, at[1:]) - self.first
        full = at[1:] > at[:-1]
        self.n = self.closed.copy()
        self.n[full] += data[at[1:][full] - 1] != 10

    def after(self, k: np.ndarray) -> np.ndarray:
        out = np.where(k > 0, self.at[1:], self.at[:-1])  # 0 lines, or past an unclosed last line
        inside = (k > 0) & (k <= self.closed)
        out[inside] = self.ends[self.first[inside] + k[inside] - 1] + 1
        return out


def _chars(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points of data[lo:hi] for each pair."""
    rest = np.flatnonzero((data & 0xC0) == 0x80)
    return (hi - lo) - (np.searchsorted(rest, hi) - np.searchsorted(rest, lo))


def transform(texts: pa.Array, draws: list[np.ndarray], rate: int, spm: int) -> dict[str, pa.Array]:
    """The columns of ``fill_in_middle`` but the id."""
    data, at = _bytes(texts)
    cuts = Cuts(data, at)
    h1, h2, h3, h4 = draws
    one, two = h1 % (cuts.n + 1), h2 % (cuts.n + 1)
    start, end = at[:-1], at[1:]
    a, b = cuts.after(np.minimum(one, two)), cuts.after(np.maximum(one, two))
    plain = (start == end) | _holds_mark(data, at) | (h3 % 100 >= rate)
    spm_form = ~plain & (h4 % 100 < spm)
    length = end - start + np.where(plain, 0, 3 * MARK)
    place = np.concatenate([[0], np.cumsum(length)])
    o, pre, suf = place[:-1], a - start, end - b
    # where prefix, middle and suffix begin in the output
    to_prefix = np.where(spm_form, o + 2 * MARK + suf, o + MARK)
    to_suffix = np.where(spm_form, o + MARK, o + 2 * MARK + pre)
    to_middle = o + 3 * MARK + pre + suf
    moves = np.stack([to_prefix - start, to_middle - a, to_suffix - b], 1)
    moves[plain] = (o - start)[plain, None]
    out = np.empty(place[-1], np.uint8)
    scatter(data, np.stack([start, a, b], 1).reshape(-1), moves.reshape(-1), out)
    for where, mark in ((to_prefix, PREFIX), (to_suffix, SUFFIX), (to_middle, MIDDLE)):
        out[(where[~plain] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    form = np.where(plain, "plain", np.where(spm_form, "spm", "psm"))
    return {"n": pa.array(cuts.n, pa.int64()), "form": pa.array(form.tolist(), pa.string()),
            "prefix_chars": pa.array(_chars(data, start, a), pa.int64(), mask=plain),
            "middle_chars": pa.array(_chars(data, a, b), pa.int64(), mask=plain), "output": _strings(out, place)}


def restore_texts(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts, from the outputs and their forms alone."""
    data, at = _bytes(outputs)
    form = np.array(forms.to_pylist(), dtype=object)
    moved = form != "plain"
    start, end = at[:-1], at[1:]
    marks = _marks(data)
    doc = np.searchsorted(at, marks, side="right") - 1
    mine = moved[doc] & (marks + MARK <= end[doc])
    marks, doc = marks[mine], doc[mine]
    if not np.array_equal(doc, np.repeat(np.flatnonzero(moved), 3)):
        raise ValueError("an output has not the three markers of its form")
    m = marks.reshape(-1, 3)
    want = np.array([list(ORDER[f]) for f in form[moved]], np.uint8).reshape(-1, 3)
    if not np.array_equal(data[m + 1], want) or not np.array_equal(m[:, 0], start[moved]):
        raise ValueError("markers stand in another order than the form says")
    spm = form[moved] == "spm"
    lo = np.stack([start, end, end], 1)  # plain: the whole text is the prefix
    hi = np.stack([end, end, end], 1)
    first, second = (m[:, 0] + MARK, m[:, 1]), (m[:, 1] + MARK, m[:, 2])
    lo[moved] = np.stack([np.where(spm, second[0], first[0]), m[:, 2] + MARK, np.where(spm, first[0], second[0])], 1)
    hi[moved] = np.stack([np.where(spm, second[1], first[1]), end[moved], np.where(spm, first[1], second[1])], 1)
    size = (hi - lo).reshape(-1)
    to = np.concatenate([[0], np.cumsum(size)])
    text = gather(data, to[:-1], lo.reshape(-1) - to[:-1], int(to[-1]))
    return _strings(text, to[::3])


def _draw(id_col: str, seed: int, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n (lines), form (psm, spm or plain), prefix_chars, middle_chars
    (code points; null for plain), output (the whole transformed text).

    Cuts and form are drawn from the SHA-256 of ``seed:id``, so reruns agree and repeated rows are
    repeated alike.  ``rate``: percentage of texts transformed; ``spm``: of those, percentage in
    suffix-first order.  A null text is empty; empty texts and those that hold a marker are plain.  A
    null id draws as the empty string.  Texts of any length are cut whole, an empty table gives an
    empty result, and other columns are not read."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                draws = [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_pydict({id_col: part.column("id")} | transform(part.column("text"), draws, rate, spm))

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[_draw(id_col, seed, k) for k in (1, 2, 3, 4)])
    return rows.mapInArrow(run, schema)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``made`` with the exact text of each output in the new column ``name``, rebuilt from output and
    form.  Neither may be null; an output that does not fit its form is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, output_col):
                yield part.append_column(name, restore_texts(part.column(output_col), part.column(form_col)))

    return made.mapInArrow(run, T.StructType(made.schema.fields + [T.StructField(name, T.StringType())]))
