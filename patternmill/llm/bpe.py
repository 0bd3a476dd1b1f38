"""Byte-level BPE with a pair occurrence index.

The distinct words of a slice of a partition lie in one array of symbols with links to their neighbours. The index
maps each pair that has a merge rank to all its positions. Ranks are taken in ascending order; all positions of the
pair are merged from left to right, and the lists of the pairs to the left and right of each are updated. A word's
merges do not depend on other words, so the ids are those of encoding each word alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternmill.llm.common import slices

#: The splitting pattern of byte-level BPE vocabularies of this kind (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, "PairIndexBPE"] = {}
_SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Vocabulary and merges of a byte-level BPE tokenizer file, with a bounded memory of known words."""

    def __init__(self, path: str, remember: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.pieces[k] = bytes(of_letter[c] for c in token)
        for token, k in self.special.items():
            self.pieces[k] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in told["model"]["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            self.ranks.setdefault(a << _SHIFT | b, rank)
        keys = np.fromiter(self.ranks.keys(), np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: the ids of words as 32-bit numbers
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit numbers, all words through one pair occurrence index."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        n = len(symbols)
        ends = np.cumsum([len(r) for r in raw])
        last = np.zeros(n, bool)
        last[ends[ends > 0] - 1] = True
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.where(np.concatenate([[True], last[:-1]]) if n else last, -1, np.arange(-1, n - 1))
        where: dict[int, list[int]] = {}
        if n > 1:
            pairs = symbols[:-1] << _SHIFT | symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[found] == pairs) & ~last[:-1])
            rank = self.key_ranks[found[hit]]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                where[int(rank[group[0]])] = hit[group].tolist()
        sym, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        ranks = self.ranks.get
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            places = where.pop(rank)
            places.sort()
            for p in places:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = c, -1
                t = nxt[p] = nxt[q]
                if t >= 0:
                    prv[t] = p
                    r = ranks(c << _SHIFT | sym[t])
                    if r is not None:
                        if r in where:
                            where[r].append(p)
                        else:
                            where[r] = [p]
                            heapq.heappush(active, r)
                u = prv[p]
                if u >= 0:
                    r = ranks(sym[u] << _SHIFT | c)
                    if r is not None:
                        if r in where:
                            where[r].append(u)
                        else:
                            where[r] = [u]
                            heapq.heappush(active, r)
        ids = np.array(sym, np.int32)
        alive = ids >= 0
        held = ids[alive].tobytes()
        stops = [0, *(4 * np.concatenate([[0], np.cumsum(alive)])[ends]).tolist()]
        # The order of `words` does not matter: each word's ids depend on the word alone.
        return [held[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.split(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.words(t) for t in texts]
        known = self.known
        if len(known) > self.remember:
            known.clear()
        known.update((s, np.int32(k).tobytes()) for s, k in self.special.items())
        new = list(set(chain.from_iterable(parts)).difference(known))
        known.update(zip(new, self.encode_words(new), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def coder(path: str) -> PairIndexBPE:
    """One coder for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def _prepare(df: DataFrame, source: str, out: str, kind: str) -> tuple[int, list[int], list[str], str]:
    at = df.columns.index(source)
    keep = [k for k, c in enumerate(df.columns) if c not in (source, out)]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in (source, out)), f"`{out}` {kind}"])
    return at, keep, [*(df.columns[k] for k in keep), out], ddl


def encode_bpe(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Put the ids of each whole text in place of the text column; a null or empty text has no ids.

    Special tokens in a text are taken as such. Other columns stay, repeated rows too; a column named `out` already is
    replaced. No shuffle; a worker holds a slice of about 1 MB of text and a bounded memory of words.
    """
    at, keep, names, ddl = _prepare(df, text, out, "array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for piece in slices(batches, text, 1 << 20):
            coded = own.encode([t or "" for t in piece.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), _lists(coded)], names=names)

    return df.mapInArrow(run, ddl)


def decode_bpe(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids, special tokens included; null ids give an empty text. The ids stay, a column `out` is replaced."""
    df = df.drop(out)
    at, names = df.columns.index(ids), [*df.columns, out]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                lists = piece.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                texts, begin = [], 0
                for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
                    texts.append(own.decode(flat[begin : begin + n]))
                    begin += n
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, ddl)


def recode_bpe(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both steps in one worker, as encode_bpe and decode_bpe: ids, and the text decoded from them, in place of the text."""
    at, keep, names, ddl = _prepare(df.drop(decoded), text, ids, "array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for piece in slices(batches, text, 1 << 20):
            coded = own.encode([t or "" for t in piece.column(at).to_pylist()])
            texts = pa.array([own.decode(c.tolist()) for c in coded], pa.string())
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), _lists(coded), texts], names=[*names, decoded])

    return df.drop(decoded).mapInArrow(run, f"{ddl}, `{decoded}` string")


def _lists(coded: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode the whole texts of documents; counts and digests of both."""
    both = recode_bpe(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
