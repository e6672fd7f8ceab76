"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A document costs a linear share and, for attention, one with the square of its length. Whole sequences are cut
off long documents first; what is left is sorted in descending order, and each piece goes to the sequence of
lowest cost that still has room for it. Where none has, the piece is cut to fill the emptiest sequence. The
sequences of a batch hold exactly its tokens: as many full ones as fit, and powers of two for the rest.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wickflow.llm.common import named

END_ID = 1
LENGTH = 2048
#: A batch is packed once it holds so many documents or tokens; this bounds a task's memory.
BATCH_DOCS = 4096
BATCH_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_characters() -> str:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printed else next(others)) for b in range(256))


class WordTokenizer:
    """Token ids of texts from a tokenizers file whose tokens never span ASCII white space: words are encoded once and kept.

    Most words are letters and then marks. Where the file splits between the two and lower-cases, which is tried on a few
    words first, the letters go straight to its model, and each part is kept as well; other words take the whole way.
    """

    KEPT = 300_000
    MARKS = ".,!?;:|*&%$#()-\""
    PROBES = ("Bonjour,", "straße.", "Éte!!", "niño;", "the", "tionally###")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_characters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.direct = all(self._split(w) == self._whole(w) for w in self.PROBES)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _split(self, word: str) -> bytes | None:
        letters = word.rstrip(self.MARKS)
        if not letters.isalpha() or max(letters) >= "\u0250" or "\u0130" in letters:
            return None  # of the letters below U+0250, lower case is one letter for all but U+0130, and NFC is plain
        found = []
        for part, core in ((letters.lower(), True), (word[len(letters) :], False)):
            if part and part not in self.parts:
                if core:
                    shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                    ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
                else:
                    ids = self._whole(part)
                if len(self.parts) >= self.KEPT:
                    self.parts.clear()
                self.parts[part] = ids
            found.append(self.parts[part] if part else b"")
        return b"".join(found)

    def _learn(self, word: bytes) -> bytes:
        text = word.decode()
        ids = self._split(text) if self.direct else None
        if ids is None:
            ids = self._whole(text)
        if len(self.words) >= self.KEPT:
            self.words.clear()
        self.words[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        known, learn = self.words.get, self._learn
        return b"".join([known(w) or learn(w) for w in text.split()])


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps its words over tasks."""
    return WordTokenizer(path)


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def sequence_lengths(tokens: int, length: int) -> list[int]:
    """Full sequences, then powers of two that sum to the rest; none is padded."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; sequences are numbered from 0."""
    pieces, left, serial = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            pieces.append((doc, start, length, serial, 0))
            serial += 1
        if n % length:
            left.append((n % length, doc, n - n % length))
    left.sort(key=lambda x: (-x[0], x[1]))
    room = sequence_lengths(sum(n for n, _, _ in left), length)
    size, spent = list(room), [0.0] * len(room)
    by_cost = sorted((0.0, s) for s in range(len(room)))
    for n, doc, start in left:
        while n:
            at = next((k for k, (_, s) in enumerate(by_cost) if room[s] >= n), None)
            if at is None:  # no room for all of it: it fills the sequence with the most room
                at = max(range(len(by_cost)), key=lambda k: (room[by_cost[k][1]], -k))
            s = by_cost.pop(at)[1]
            take = min(n, room[s])
            pieces.append((doc, start, take, serial + s, size[s] - room[s]))
            room[s] -= take
            spent[s] += cost(take)
            n, start = n - take, start + take
            if room[s]:
                bisect.insort(by_cost, (spent[s], s))
    return pieces


def pack_documents(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian 32-bit token ids), doc_tokens, sequence_id, offset.

    A document's tokens are those of its text and end_id; a null or blank text has end_id alone. Sequences hold
    `length` tokens or a power of two, without padding. Each task packs the rows that it reads, in batches of
    bounded size and without a shuffle, so sequence_id (partition and serial) depends on how the input is split.
    Null ids are kept. Repeated rows are packed as often as they come; an empty table gives none. Texts are read whole, and a
    long one is cut over as many sequences as it takes. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        tokenizer, serial = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        kinds = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (f.split()[0] for f in SCHEMA.split(", "))])
        ids, tokens = [], []

        def flush():
            nonlocal serial
            lengths = [len(t) for t in tokens]
            pieces = pack(lengths, length)
            for at in range(0, len(pieces), 4096):
                columns = zip(
                    *(
                        (ids[d], s, n, tokens[d][s : s + n].tobytes(), lengths[d], serial + q, o)
                        for d, s, n, q, o in pieces[at : at + 4096]
                    )
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types)], schema=kinds)
            serial += 1 + max((p[3] for p in pieces), default=0)
            ids.clear()
            tokens.clear()

        held, end = 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                ids.append(doc_id.as_py())
                tokens.append(np.frombuffer(tokenizer.encode(text.as_py() or b"") + end, dtype="<u4"))
                held += len(tokens[-1])
                if len(ids) >= BATCH_DOCS or held >= BATCH_TOKENS:
                    yield from flush()
                    held = 0
        yield from flush()

    doc_id, text = named(docs, id_col, text_col)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, SCHEMA)
