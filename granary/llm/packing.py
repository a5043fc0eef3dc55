"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's tail (what is left after
whole windows are cut from it) goes to the open window that it fits best. When none fits, the
fullest is topped up with the tail's head and emitted, so it leaves without padding. At the
end the leftovers are merged into full windows, and the last partial one is cut into windows
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, OPEN, END_ID = 2048, 32, 1
#: Entries of a worker's cache of tokenized words.
CACHE = 600_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"

#: White space that isn't single, and characters on which splitters might differ; such texts go to the tokenizer whole.
_RUNS = ("  ", "\n\n", "\n ", " \n", "<|endoftext|>")
_OUTSIDE = re.compile("[^ -~¡-ɏ]")
#: A space between letters starts a pre-token whatever stands around it, so a long text may be cut there.
_BORDER = re.compile("(?<=[a-z]) (?=[a-z])")
#: Characters of a long text that are encoded at once.
PORTION = 1 << 19


def _plain(text: str) -> bool:
    if text[0] == "\n" or text[-1] in " \n" or any(x in text for x in _RUNS):
        return False
    line = text.replace("\n", "")
    return line.isprintable() and (line.isascii() or _OUTSIDE.search(line) is None)


class _Words(dict):
    """Ids of words as bytes, encoded when first asked for; emptied when full."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = np.array(self.encode(word), dtype=np.uint32).tobytes()
        return found


class Encoder:
    """Ids of texts by a byte-level BPE file of the `tokenizers` library.

    Such a BPE never merges across the borders of its pre-tokens, and a single space or line
    feed between other characters is such a border. So plain texts are encoded word by word
    through a bounded cache; every other text goes to the tokenizer whole. `ranks`: the same vocabulary as a rank file, a faster encoder of
    single words with the same ids; without it the tokenizer encodes these too.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import base64

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        encode = lambda word: self.whole.encode(word, add_special_tokens=False).ids
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.words = _Words(encode)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= 2 * PORTION:
            return self._encode(text)
        out, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + PORTION)
            to = border.start() if border else len(text)
            out.append(self._encode(text[at:to]))
            at = to
        return np.concatenate(out)

    def _encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if not _plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        # a word keeps the space before it; a line feed stands alone
        parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), dtype=np.uint32)


class Packer:
    """Packs one partition; `add` and `close` give (sequence, pieces), a piece being (doc index, start, length, ...)."""

    def __init__(self, window: int = WINDOW, slots: int = OPEN):
        self.window, self.slots = window, slots
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc, n: int) -> Iterator[list]:
        whole = n // self.window * self.window
        for s in range(0, whole, self.window):
            yield [(doc, s, self.window)]
        start, rest = whole, n - whole
        while rest:
            fits = [i for i, (used, _) in enumerate(self.open) if used + rest <= self.window]
            if fits:
                i = max(fits, key=lambda i: self.open[i][0])
                used, pieces = self.open[i]
                pieces.append((doc, start, rest))
                if used + rest == self.window:
                    self.open.pop(i)
                    yield pieces
                else:
                    self.open[i] = (used + rest, pieces)
                return
            if len(self.open) < self.slots:
                self.open.append((rest, [(doc, start, rest)]))
                return
            i = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(i)
            free = self.window - used
            pieces.append((doc, start, free))
            yield pieces
            start, rest = start + free, rest - free

    def close(self) -> Iterator[list]:
        left = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces]
        self.open, total, at = [], sum(p[2] for p in left), 0
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in reversed(range((total % self.window).bit_length())) if total % self.window >> b & 1]
        for size in sizes:
            out = []
            while size:
                doc, start, n = left[at]
                take = min(n, size)
                out.append((doc, start, take))
                size -= take
                left[at] = (doc, start + take, n - take)
                at += take == n
            yield out


def _pack(make: Callable[[], Encoder], window: int, slots: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, held = make(), Packer(window, slots), {}
        base, count, index = TaskContext.get().partitionId() << 33, 0, 0
        out: list[tuple] = []

        def put(pieces: list) -> None:
            nonlocal count
            at = 0
            for doc, start, n in pieces:
                doc_id, ids, left = held[doc]
                x = ids[start : start + n]
                out.append((doc_id, start, n, zlib.crc32(x.astype("<u4").tobytes()), len(ids), base + count, at, x.tolist() if with_ids else None))
                at += n
                if left == n:
                    del held[doc]
                else:
                    held[doc] = (doc_id, ids, left - n)
            count += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.list_(pa.int32()))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                held[index] = (doc_id, ids, len(ids))
                for pieces in packer.add(index, len(ids)):
                    put(pieces)
                index += 1
                if len(out) > 2000:
                    yield batch()
        for pieces in packer.close():
            put(pieces)
        yield batch()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slots: int = OPEN, with_ids: bool = True
) -> DataFrame:
    """Pieces of tokenized documents in sequences of at most `window` tokens.

    A document is its text's ids and then END_ID. Columns: doc_id, start (its ids before the
    piece), length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset (in the sequence, gapless from 0) and ids (null unless with_ids). Sequences shorter
    than the window have lengths that are powers of two.

    tokenizer, ranks: files that every executor has. A null or empty text is the END_ID alone.
    Ids may be null or repeat: each row is a document. Of open windows that fit alike the
    oldest is taken. Long texts are encoded in portions, cut where the tokenizer cuts too. An
    empty table gives no pieces; other columns are not read and may have any names. A partition is packed alone, in the order of its rows, so a lost
    task that runs again gives its sequences again.
    """
    C.tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pack(lambda: Encoder(tokenizer, ranks), window, slots, with_ids), _PIECES)
