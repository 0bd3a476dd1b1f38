"""Token counts of whole texts, with overlapping chunks for huge documents.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a position that
both have as a token boundary and that is proven stable: no piece of the vocabulary holds the two characters on its
sides next to each other, so no sequence of merges can ever cross it, whatever stands around. If the overlap holds no
such position it is widened, in the end to all that is not yet spliced, so the result always equals the library's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from patternmill.llm.common import slices, without

SPACE = "▁"
_LOADED: dict[str, "SplicedEncoder"] = {}


class SplicedEncoder:
    """Encodes with a sentencepiece model; texts of over `chunk` characters go chunk by chunk."""

    def __init__(self, model_file: str, chunk: int = 8192, overlap: int = 256):
        import sentencepiece

        if not 0 < overlap < chunk:
            raise ValueError("overlap must be positive and less than chunk")
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.joined: set[str] = set()
        for i in range(self.model.get_piece_size()):
            if not self.model.is_byte(i) and not self.model.is_control(i) and not self.model.is_unknown(i):
                piece = self.model.id_to_piece(i)
                self.joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
        #: counts of what the splicing did, for tests and monitoring
        self.chunks = self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross the place before text[at]."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Ids of text[start:end] and where each begins in text."""
        self.chunks += 1
        found = self.model.encode(text[start:end], num_threads=1, return_type="offset_mapping")
        return found["ids"], [start + begin for begin, _ in found["offsets"]]

    def _common(self, text: str, low: int, high: int, one: list[int], two: list[int]) -> int | None:
        """The last stable position in (low, high) at which both encodings begin a token."""
        both = set(two[bisect_left(two, low + 1) : bisect_left(two, high)])
        for k in range(bisect_left(one, high) - 1, -1, -1):
            at = one[k]
            if at <= low:
                return None
            if at in both and self.stable(text, at):
                return at
        return None

    def encode(self, text: str) -> list[int]:
        n = len(text)
        if n <= self.chunk:
            return self.model.encode(text, num_threads=1)
        done: list[int] = []
        start, spliced, end = 0, 0, self.chunk
        ids, begins = self._encode(text, start, end)
        while end < n:
            overlap = self.overlap
            while True:
                low = max(spliced, end - overlap)
                after = min(n, low + self.chunk + overlap)
                next_ids, next_begins = self._encode(text, low, after)
                at = self._common(text, low, end, begins, next_begins)
                if at is not None or low == spliced:
                    break
                self.widened += 1
                overlap *= 2
            if at is None:
                # Nothing stable since the last splice: take the unspliced part as one chunk, twice as long.
                self.widened += 1
                end = min(n, end + (end - start))
                ids, begins = self._encode(text, start, end)
                continue
            done += ids[bisect_left(begins, spliced) if spliced else 0 : bisect_left(begins, at)]
            start, spliced, end, ids, begins = low, at, after, next_ids, next_begins
        return done + ids[bisect_left(begins, spliced) if spliced else 0 :]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        for k, ids in zip(short, self.model.encode([texts[k] for k in short], num_threads=1), strict=True):
            out[k] = len(ids)
        for k, t in enumerate(texts):
            if len(t) > self.chunk:
                out[k] = len(self.encode(t))
        return out


def encoder(model_file: str, chunk: int, overlap: int) -> SplicedEncoder:
    """One encoder for each model and Python worker."""
    key = f"{model_file}|{chunk}|{overlap}"
    if key not in _LOADED:
        _LOADED[key] = SplicedEncoder(model_file, chunk, overlap)
    return _LOADED[key]


def count_tokens(df: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens", chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """Put the token count of each whole text in place of the text column.

    A null text counts as empty (0 tokens). Repeated rows are counted each; other columns stay as they are, but one
    that is named `out` already is replaced. One pass, no shuffle; a worker holds one slice of about 2 MB and one text.
    """
    df = without(df, out)
    at = df.columns.index(text)
    rest = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text), f"`{out}` long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file, chunk, overlap)
        for piece in slices(batches, text, 2 << 20):
            counted = own.counts([t or "" for t in piece.column(at).to_pylist()])
            kept = [piece.column(k) for k, c in enumerate(df_columns) if c != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counted, pa.int64())], names=[*rest, out])

    df_columns = df.columns
    return df.mapInArrow(run, schema)
