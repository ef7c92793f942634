"""Quality rules by compression bands.

Zstandard ratios (compressed bytes / bytes) of the whole document and of fixed chunks place a text
in a band. A ratio under the band is repetitive text, one over it is incompressible text. The limits
depend on the length, as a short text has little to refer back to.

``kept`` takes the base rules and the bands; ``in_band`` is the bands' verdict alone.

Cases: a null or empty text has no words, fails the base rules, is in no band and not kept; its ratio is null.
Repeated rows and equal ids are judged row by row. Extra columns are never looked at. An empty table
gives an empty result. Very long texts are read whole, chunk by chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import text as tx


@dataclass(frozen=True)
class Bands:
    """Limits of the ratios. ``whole``: (bytes at least, lowest ratio, highest ratio), longest last.

    They lie in the gaps of each length class: at sf0.1, clean texts have 0.54 to 0.75 from 256 bytes, 0.41
    to 0.60 from 1 KB, 0.37 to 0.48 from 4 KB and 0.34 to 0.42 from 32 KB; repetitive ones have at most 0.31,
    0.23 and 0.06, templated lines 0.25 to 0.30, and random alphanumeric words 0.83 falling to 0.73.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.25, 1.10),
        (256, 0.40, 0.80),
        (512, 0.40, 0.75),
        (1024, 0.34, 0.66),
        (2048, 0.33, 0.64),
        (4096, 0.33, 0.60),
        (8192, 0.32, 0.58),
        (16384, 0.31, 0.55),
        (32768, 0.31, 0.52),
    )
    #: Bytes of a chunk; a tail of under half of it joins no chunk.
    chunk: int = 4096
    chunk_low: float = 0.33
    chunk_high: float = 0.64
    #: Share of a document's chunks outside their band that rejects it.
    chunk_share: float = 0.30
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, in_band boolean, ratio double, chunks long, chunks_low long, chunks_high long"
)
_SYMBOL = tx.lut(lambda b: chr(b) in "#*$%&|<>")


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The five word, symbol, line and repetition counts of each row."""
    starts, ends, first = tx.words(buf, offs, tx.SPACELESS)
    h = tx.Hasher(buf)
    n_words = np.diff(first)
    row = tx.row_of(first)
    wide, at = tx.windows(h(starts, ends), first, 3)
    twice = at[tx.repeated(wide ^ tx.mix(row[at].astype(np.uint64) + np.uint64(1)))]
    hit = tx.covered(twice, 3, len(starts))
    # Lines: row starts and what follows a newline; those with a word are compared.
    newline = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offs[:-1], newline + 1]))
    begin = begin[begin < len(buf)]
    stop = np.empty_like(begin)
    if len(begin):
        stop[:-1], stop[-1] = begin[1:], len(buf)
        stop -= (buf[stop - 1] == 10) & (stop - 1 >= begin)
    wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[wordy], stop[wordy]
    line_row = np.searchsorted(offs, begin, "right") - 1
    key = h(begin, stop) ^ tx.mix(line_row.astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(line_row, minlength=len(n_words))
    _, one = np.unique(key, return_index=True)
    distinct = np.bincount(line_row[one], minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": tx.per_row(tx.SPACELESS[buf] & tx.LEAD[buf], offs),
        "n_symbols": tx.per_row(_SYMBOL[buf], offs),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": tx.per_row(hit, first),
    }


def ratios(data: memoryview, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Whole ratio; chunks; chunks under and over their band."""
    n = len(data)
    if not n:
        return float("nan"), 0, 0, 0
    whole = len(z.compress(data)) / n
    chunks = low = high = 0
    for at in range(0, n, bands.chunk) if n > bands.chunk else ():
        at = min(at, n - bands.chunk)  # the last ends where the text does
        r = len(z.compress(data[at : at + bands.chunk])) / bands.chunk
        chunks += 1
        low += r < bands.chunk_low
        high += r > bands.chunk_high
    return whole, chunks, low, high


def in_band(n_bytes: int, ratio: float, chunks: int, low: int, high: int, bands: Bands) -> bool:
    """The verdict of the method."""
    if not n_bytes:
        return False
    _, lo, hi = next(b for b in reversed(bands.whole) if n_bytes >= b[0])
    return lo <= ratio <= hi and low + high <= bands.chunk_share * chunks


def judge(buf: np.ndarray, offs: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    """All columns but doc_id for the rows of a slice."""
    out = base_counts(buf, offs)
    z = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=True)
    view = memoryview(np.ascontiguousarray(buf))
    rows = [ratios(view[a:b], bands, z) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    ok = np.array([in_band(n, *r, bands) for n, r in zip(np.diff(offs).tolist(), rows, strict=True)], bool)
    failed = (out["n_words"] < bands.min_words) | (100 * out["n_repeat_words"] > bands.max_repeat_percent * out["n_words"])
    out |= {"base_failed": failed, "kept": ok & ~failed, "in_band": ok}
    for k, name in enumerate(("ratio", "chunks", "chunks_low", "chunks_high")):
        out[name] = np.array([r[k] for r in rows], float if k == 0 else np.int64)
    return out


def score(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document with its counts, ratios and verdict."""
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("in_band", pa.bool_()), ("ratio", pa.float64())]
        + [(c, pa.int64()) for c in ("chunks", "chunks_low", "chunks_high")]
    )

    def run(batches):
        for batch in batches:
            buf, offs = tx.flat(batch.column(1))
            for a, b in tx.slices(offs):
                got = judge(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bands)
                cols = [batch.column(0).slice(a, b - a)]
                cols += [pa.array(got[f.name], f.type, from_pandas=True) for f in list(schema)[1:]]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they came with."""
    names = docs.columns
    arrow = {}

    def run(batches):
        for batch in batches:
            buf, offs = tx.flat(batch.column(arrow["at"]))
            for a, b in tx.slices(offs):
                ok = judge(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], bands)["kept"]
                yield batch.slice(a, b - a).filter(pa.array(ok))

    arrow["at"] = names.index("text")
    return docs.mapInArrow(run, docs.schema)
