"""SentencePiece encoding and decoding by a table of distinct chunks.

The model's pieces never cross from a character to a whitespace marker (checked when the model is loaded), so
the text parts before each run of markers are encoded independently.  Each distinct chunk (a run of markers and
what follows up to the next one) is segmented once, and ids, decoded text and counts are put back by position.
The table lives in the Python worker: bounded in bytes, with no shuffle of words, and rebuilt by any executor that
takes over a lost one's task.  So a chunk is segmented once a task that meets it rather than once a corpus; a
table of the corpus would cost a shuffle of every text to spare that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm._common import SLICE_BYTES, map_arrow, slices

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
_CUT = re.compile(f"[^ {MARK}][ {MARK}]")


class ChunkTable:
    """Distinct chunks and what the library makes of them.

    Two generations of at most ``limit`` bytes each (plus what one slice of texts needs) bound the memory: a full
    young generation becomes the old one, and old chunks that are met again move over.
    """

    #: Bytes that an entry takes beside its characters: two strings and their place in the table, about.
    ENTRY = 250

    def __init__(self, model: bytes, limit: int = 64 << 20):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = [p for i in range(self.sp.get_piece_size()) if MARK in (p := self.sp.id_to_piece(i)).lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}
        size = self.sp.get_piece_size()
        self.names = [str(i) for i in range(size)]
        self.plain = {i for i in range(size) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))}
        self.lone = self.sp.piece_to_id(MARK)
        self.changed: dict[str, str] = {}  # chunks whose decoded text isn't the chunk itself

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker (the library's dummy prefix puts it back)."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if text[0] != MARK and text[-1] != MARK and MARK + MARK not in text:
            return text.split(MARK)
        return [c[1:] for c in _RUNS.findall(MARK + text)]

    def learn(self, chunks: list[str]) -> dict[str, str]:
        """The ids of all of these chunks, joined by commas."""
        met = set(chunks)
        need = sum(map(len, met)) * 6 + self.ENTRY * len(met)
        if self.held + need > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
            if len(self.changed) * self.ENTRY > self.limit:
                self.changed, self.old = {}, {}
        young, old = self.young, self.old
        new = [c for c in met if c not in young]
        self.held += sum(map(len, new)) * 6 + self.ENTRY * len(new)
        young.update((c, old[c]) for c in new if c in old)
        order = [c for c in new if c not in young]
        names, plain = self.names, self.plain
        for c, x in zip(order, self.sp.encode(order, num_threads=1) if order else [], strict=True):
            x = x if c else [self.lone]
            young[c] = ",".join([names[i] for i in x])
            # Pieces of text decode to themselves; bytes, unknowns and markers go through the library.
            if (not plain.issuperset(x) or MARK in c) and (back := self.sp.decode(x)) != c:
                self.changed[c] = back
        return self.young

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text: ids joined by commas, and the decoded text."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            parts = [next(self._encode([x])) for x in pieces(texts[0], SLICE_BYTES)]
            yield ",".join(ids for ids, _ in parts), " ".join(back for _, back in parts)
        else:
            yield from self._encode(texts)

    def _encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        parts = [self.chunks(t) for t in texts]
        known, changed = self.learn([c for chunks in parts for c in chunks]), self.changed
        for chunks in parts:
            back = [changed.get(c, c) for c in chunks] if changed else chunks
            yield ",".join([known[c] for c in chunks]), " ".join(back)


def pieces(text: str, size: int = SLICE_BYTES) -> Iterator[str]:
    """A long text, cut before chunks: the marker at each cut is left out, as chunks() leaves out a first marker."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut or cut.end() == len(text):
            break
        yield text[start : cut.start() + 1]
        start = cut.end()
    yield text[start:]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = False, decoded: bool = False, limit: int = 64 << 20) -> DataFrame:
    """Encodes every whole text as the library does, without begin or end ids, and decodes the ids again.

    Returns id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, then on demand
    ``ids`` (array<int>) and ``decoded``.  Null and empty texts have no tokens; repeated rows stay repeated;
    ids may be null or of any type; other columns are not read, so their names can't clash.  A text of any length
    is encoded whole, a long one in pieces that are cut between chunks.
    The model file (a fixed vocabulary) is read by the driver and sent to the workers.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches):
        chunks = ChunkTable(model, limit)
        for batch in slices(batches, text_col):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = list(chunks.encode(texts))
            out = [batch.column(0), pa.array([r[0].count(",") + 1 if r[0] else 0 for r in rows], pa.int64())]
            out += [pa.array([hashlib.sha256(r[i].encode()).hexdigest() for r in rows], pa.string()) for i in (0, 1)]
            if ids:
                flat = np.fromstring(",".join(r[0] for r in rows if r[0]), np.int32, sep=",")
                ends = np.cumsum([0, *(r[0].count(",") + 1 if r[0] else 0 for r in rows)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            if decoded:
                out.append(pa.array([r[1] for r in rows], pa.string()))
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return map_arrow(docs.select(id_col, text_col), run, schema)
