"""Quality rules: compression bands.

A document is rejected when zstandard compresses it too well (repetitive text) or not
at all (encoded or random data).  The ratio compressed / raw is taken over the whole
document and over every fixed-size chunk; the limits depend on the length, because
short texts compress less.  The base rules (too few words, too many repeated three-word
windows) come first.

Limits belong to the bands (a ratio that equals one passes).  Very long texts are read
whole and compressed chunk by chunk.  Nulls count as empty texts (no words, rejected).  Every row is judged alone: repeated
rows get equal verdicts, an empty table gives an empty table, further columns are
carried through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import arrow_map, byte_slices, free_name

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CHUNK_BYTES = 4096
LEVEL = 3
SLICE_BYTES = 4 << 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Length-specific limits: (bytes below, lowest ratio, highest ratio) of one compressed piece.
BANDS = [(512, 0.30, 0.98), (1024, 0.25, 0.90), (2048, 0.20, 0.80), (4096, 0.18, 0.75), (None, 0.14, 0.70)]
#: Part of the chunks that may leave their band: none, so one bad chunk rejects a text of any length.
MAX_BAD_CHUNKS = 0.0

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_ratio double, bad_chunks double, base_failed boolean, kept boolean"


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = x[:-2] * len(ids) + x[1:-1]
    if len(ids) >= 1 << 20:  # three ids no longer fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs * len(ids) + x[2:], return_inverse=True, return_counts=True)
    starts = counts[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= starts
    return int(covered.sum())


def in_band(size: int, packed: int, bands=BANDS) -> bool:
    for below, low, high in bands:
        if below is None or size < below:
            return low <= packed / size <= high
    return True


def judge(raw: bytes, pack, chunk_bytes: int = CHUNK_BYTES, bands=BANDS, max_bad: float = MAX_BAD_CHUNKS) -> tuple:
    """All signals of one text, in the order of SIGNALS."""
    words = raw.split()
    text_chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    word_chars = text_chars - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    n_repeat = repeated_window_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    ratio, bad = 0.0, 0.0
    if raw:
        packed = len(pack(raw))
        ratio = packed / len(raw)
        chunks = [raw[k:k + chunk_bytes] for k in range(0, len(raw), chunk_bytes)]
        if len(chunks) > 1 and len(chunks[-1]) < chunk_bytes // 2:  # a short rest joins the chunk before it
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        bad = sum(not in_band(len(c), len(pack(c)), bands) for c in chunks) / len(chunks)
    kept = not failed and in_band(len(raw), round(ratio * len(raw)), bands) and bad <= max_bad
    return (len(words), word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, ratio, bad, failed, kept)


def quality_signals(docs: DataFrame, text: str = "text", level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES,
                    bands=BANDS, max_bad: float = MAX_BAD_CHUNKS) -> DataFrame:
    """``docs`` with a struct column ``quality`` of all signals and the verdict ``kept``.

    One pass over the rows where they were read; nothing is shuffled.
    """
    name = free_name(docs.columns, "quality")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(SIGNALS))])
    fields = [x.rsplit(" ", 1) for x in SIGNALS.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batch: pa.RecordBatch):
        # A compressor per batch: cheap, and nothing survives between tasks.
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False).compress
        for part in byte_slices(batch, text, SLICE_BYTES):
            raw = part.column(text).cast(pa.binary())
            rows = [judge(x.as_py() or b"", pack, chunk_bytes, bands, max_bad) for x in raw]
            columns = [pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows), fields, strict=True)]
            found = pa.StructArray.from_arrays(columns, [f for f, _ in fields])
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])

    return arrow_map(docs, run, schema)


def quality_filter(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with the columns of ``docs``."""
    marked = quality_signals(docs, text, **options)
    return marked.where(F.col(marked.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
