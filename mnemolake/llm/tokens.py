"""Token counts with overlap resynchronisation for huge documents, and the exact encoder under them.

Two exact ways to one result, the ids that the ``tokenizers`` library gives:

* A text up to ``chunk_chars`` is cut into pre-tokens by vectorised rules (the byte-level pattern, below). Each
  distinct pre-token is encoded once by the library and remembered per Python worker, in a table of bounded size.
* A longer text is encoded by the library in overlapping chunks with offsets. A boundary between two pre-tokens
  that both chunks see, clear of both chunks' ends, is proven stable: what follows depends on the text after it
  only. There the chunks are spliced. If an overlap has no such boundary it is widened, up to the whole text.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import range_hashes, slices, small_batches, trim

CHUNK_CHARS, OVERLAP_CHARS = 65_536, 512
#: A vocabulary is broadcast; a file above this is refused.
VOCABULARY_BYTES = 64 << 20
#: A worker remembers pre-tokens in a table of 2 ** SLOT_BITS places, and about POOL ids of theirs.
SLOT_BITS, POOL = 20, 1 << 22
SEED = 32
#: The pattern that byte-level pre-tokenization stands for, and its contractions.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)


def character_classes() -> np.ndarray:
    """The class of every code point; UNSURE where Unicode versions may differ (unassigned here)."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get((c := unicodedata.category(chr(i)))[0], UNSURE if c in ("Cn", "Cs") else OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(WHITE_SPACE)] = SPACE
    return out


def piece_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices at which pre-tokens of BYTE_LEVEL_PATTERN start; ``first`` has the index of each text's start."""
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    start = head.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(start)[:-1]
    ends = np.append(runs[1:], n)
    kind = kinds[runs]
    # The last white-space character before something visible stands alone, or joins it if it is a space.
    before = (kind == SPACE) & ~head[ends]
    last = ends[before] - 1
    start[last] = True
    joins = last[points[last] == 32]
    start[joins + 1] = False
    # Contractions: a lone apostrophe that starts a match, and letters after it.
    lone = runs[(kind == OTHER) & (ends - runs == 1) & (points[runs] == 39)]
    lone = lone[start[lone] & ~head[lone + 1]]
    if len(lone):
        padded = np.append(points, [0, 0])
        for text in CONTRACTIONS:
            hit = lone[(padded[lone + 1] == ord(text[0])) & (len(text) == 1 or padded[lone + 2] == ord(text[-1]))]
            if len(text) == 2:
                hit = hit[~head[hit + 2]]
            start[hit + 1] = False
            start[hit + 1 + len(text)] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Exact ids of texts under a ``tokenizers`` JSON file, without begin, end or added special tokens."""

    def __init__(self, vocabulary: bytes, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.library.no_truncation()
        self.library.no_padding()
        said = json.loads(vocabulary)
        pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.margin = 16 + max(map(len, self.special), default=0)
        self.chunk, self.overlap = max(chunk_chars, 4 * self.margin), max(overlap_chars, 4 * self.margin)
        self.classes = character_classes() if self.plain else None
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = (np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(2))
        self.at, self.size = (np.zeros(1 << SLOT_BITS, np.int32) for _ in range(2))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text, given to the library at once."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def spliced(self, text: str) -> np.ndarray:
        """Ids of a huge text from overlapping chunks, spliced at stable common boundaries."""
        done, start, out = 0, 0, []  # text[:done] is encoded; the present chunk begins at start <= done
        size = self.chunk
        while True:
            end = min(len(text), start + size)
            ids, bounds = self._chunk(text[start:end], start)
            # bounds: offset -> index of the first id of the pre-token there. A chunk that began before `done` must
            # have a boundary there too; the first chunk begins at the text's start.
            if done not in bounds:
                start, size = max(0, done - 2 * (done - start)), size + 2 * (done - start)
                continue
            if end == len(text):
                out.append(ids[bounds[done] :])
                return np.concatenate(out)
            nxt = max((p for p in bounds if done < p <= end - self.overlap // 2 and not text[p - 1].isspace()), default=None)
            if nxt is None:  # no stable boundary: widen
                size *= 2
                continue
            out.append(ids[bounds[done] : bounds[nxt]])
            done, start, size = nxt, max(0, nxt - self.overlap // 2), self.chunk

    def _chunk(self, text: str, shift: int) -> tuple[np.ndarray, dict[int, int]]:
        """Ids of a chunk, and its pre-token boundaries that the chunk's own start can't have moved."""
        got = self.library.encode(text, add_special_tokens=False)
        bounds, before = {}, object()
        for i, (word, (a, _)) in enumerate(zip(got.word_ids, got.offsets)):
            if word is None or word != before:
                if shift == 0 or a >= self.margin:
                    bounds.setdefault(a + shift, i)
                before = word
        if shift == 0:
            bounds.setdefault(0, 0)
        return np.array(got.ids, np.uint32), bounds

    def batch(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (none if not ``ids``), and where each text's ids begin, with the total at the end."""
        odd = {i: self.spliced(t) if len(t) > self.chunk else self.whole(t) for i, t in enumerate(texts) if len(t) > self.chunk or not self.plain or any(s in t for s in self.special)}
        flat, counts = self._pieces(["" if i in odd else t for i, t in enumerate(texts)], odd, ids) if self.plain else (None, None)
        if odd:
            at = np.concatenate(([0], np.cumsum(counts))) if self.plain else None
            if ids:
                flat = np.concatenate([odd[i] if i in odd else flat[at[i] : at[i + 1]] for i in range(len(texts))])
            counts = np.array([len(odd[i]) if i in odd else counts[i] for i in range(len(texts))], np.int64)
        first = np.zeros(len(texts) + 1, np.int64)
        if len(texts):
            np.cumsum(counts, out=first[1:])
        return (flat if flat is not None else np.zeros(0, np.uint32)), first

    def _pieces(self, texts: list[str], odd: dict[int, np.ndarray], ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids by distinct pre-tokens. A text with an UNSURE character goes to ``odd`` instead."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[points]
        stops = np.cumsum([len(t) for t in texts])
        if (unsure := np.flatnonzero(kinds == UNSURE)).size:
            for i in np.unique(np.searchsorted(stops, unsure, "right")):
                odd[int(i)] = self.whole(texts[i])
                texts[i] = ""
            return self._pieces(texts, odd, ids)
        first = np.concatenate(([0], stops[:-1]))[[len(t) > 0 for t in texts]] if texts else np.zeros(0, np.int64)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = piece_starts(points, kinds, first.astype(np.int64))
        ends = np.append(starts[1:], len(points))
        # As few bytes for a code point as the slice needs; what is remembered of one width isn't found for another.
        kind = np.min_scalar_type(int(points.max()))
        wide = kind.itemsize
        key, check = range_hashes(points.astype(kind).view(np.uint8), wide * starts, wide * ends, SEED + wide, twice=True)
        at, size = self._find(joined, starts, ends, key, check)
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        flat = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])] if ids else np.zeros(0, np.uint32)
        bounds = total[np.searchsorted(starts, np.concatenate(([0], stops)))]
        return flat, np.diff(bounds)

    def _find(self, joined: str, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each pre-token; those not remembered are encoded by the library."""
        if self.used > POOL:
            self._forget()
        return self._look(joined, starts, ends, key, check)

    def _look(self, joined: str, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero((self.key[slot] != key) | (self.check[slot] != check))
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            new = miss[one]
            if (other := check[new][back] != check[miss]).any():
                # Different pre-tokens with one key: those that aren't the first of it are looked up on their own.
                rest, miss = miss[other], miss[~other]
                for some in (miss, rest):
                    at[some], size[some] = self._look(joined, starts[some], ends[some], key[some], check[some])
                return at, size
            got = [e.ids for e in self.library.encode_batch_fast([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
            self.pool[self.used : self.used + len(flat)] = flat
            place = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
            self.used += len(flat)
            into = slot[new]
            self.key[into], self.check[into], self.at[into], self.size[into] = key[new], check[new], place, sizes
            # Of pre-tokens that fell into one slot the last stays whole: all four columns were assigned in one order.
            at[miss], size[miss] = place[back], sizes[back]
        return at, size


_own: dict[int, Encoder] = {}


def worker_encoder(shared, chunk_chars: int, overlap_chars: int) -> Encoder:
    """One encoder for each Python worker, with its memory kept from task to task."""
    vocabulary = shared.value
    key = hash((vocabulary, chunk_chars, overlap_chars))
    if key not in _own:
        _own.clear()
        _own[key] = Encoder(vocabulary, chunk_chars, overlap_chars)
    return _own[key]


def forget_encoder() -> None:
    """Give up what an earlier task of this worker remembers of a vocabulary."""
    _own.clear()


def share_vocabulary(spark, path: str):
    """Broadcast a vocabulary file of the driver, of at most VOCABULARY_BYTES."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], schema: str, keep: list[str], text_col: str, encodes: bool = False) -> DataFrame:
    """``work`` on slices of rows: the columns ``keep`` and the UTF-8 text (null: empty), in bounded portions.

    The text is sent once, also where it is among ``keep``.
    """
    at = keep.index(text_col) if text_col in keep and df.schema[text_col].dataType.simpleString() == "string" else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoder()
        for batch in batches:
            text = batch.column(at).cast(pa.binary())
            sizes = [x.as_py() or 0 for x in pc.binary_length(text)]
            for a, b in slices(sizes):
                yield work(batch.slice(a, b - a), [x or b"" for x in text.slice(a, b - a).to_pylist()])
        trim()

    own = [F.col(c) for c in keep]
    small_batches(df.sparkSession)
    return df.select(*(own if at < len(keep) else [*own, F.col(text_col).cast("binary").alias("_text")])).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Token counts of whole texts: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` names a ``tokenizers`` JSON file or a ``sentencepiece`` model. One row comes out for each row that
    goes in: repeated rows and null ids stay as they are, a null or empty text has 0 bytes and 0 tokens, an empty
    table gives an empty one, and other columns of ``docs`` are ignored. Special strings inside texts are what the
    library makes of them by default. A sentencepiece text is encoded at once, whatever its length.
    """
    shared = share_vocabulary(docs.sparkSession, path)
    pieces = path.endswith(".model")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        said = [t.decode("utf-8", "replace") for t in texts]
        if pieces:
            import sentencepiece

            first = np.concatenate(([0], np.cumsum([len(x) for x in sentencepiece.SentencePieceProcessor(model_proto=shared.value).encode(said, num_threads=1)]))).astype(np.int64)
        else:
            first = worker_encoder(shared, chunk_chars, overlap_chars).batch(said, ids=False)[1]
        tokens = np.diff(first)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", [id_col], text_col, encodes=True)
