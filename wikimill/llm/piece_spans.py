"""SentencePiece encoding that keeps offsets, and decoding.

Normalization replaces the longest prefix that the model's compiled character map knows, character by character, and records for
every byte of the normalized text where its source character starts. Pieces tile the normalized text, so their borders, read
through that alignment, are byte offsets into the original text.

A normalized text falls into pre-tokens that no piece of the vocabulary joins (``token_counts.Pieces.check``). A task encodes each
distinct pre-token once, keeps its ids in one flat array, and puts the ids of a text together by array operations. Texts are cut at
pre-token borders while they are read, so a long text costs its ids and not its pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import document, to_batch
from .token_counts import PRE_TOKEN, SPACE, Pieces

SLICE = 1 << 20  # bytes of normalized text worked on at once
MEMO = 1 << 23  # characters of pre-tokens a task keeps
TOKENS = 1 << 20  # ids a batch of results holds, or those of one text
MARK = SPACE.encode()
WIDE = np.ones(256, np.int64)  # bytes of a normalized byte: a space becomes a mark of three
WIDE[32] = len(MARK)


class CharMap:
    """The compiled character map of a model: a double-array trie of source prefixes, and the texts that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix of ``data[at:]`` and the prefix length; else one character, unchanged."""
        found = None
        if self.units:
            unit = self.units[0]
            node = _offset(unit)
            for i in range(at, len(data)):
                node ^= data[i]
                unit = self.units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found:
            return self.texts[found[0]:self.texts.index(0, found[0])], found[1]
        n = 1
        while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
            n += 1
        return data[at:at + n], n


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


@dataclass(frozen=True)
class Shape:
    """How a model treats white space, and its character map."""

    chars: CharMap
    dummy_prefix: bool = True
    squeeze: bool = False  # drop outer spaces and all but one of a run

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with marks for spaces, and the source offset of each byte, followed by that of its end."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.chars.units and not self.squeeze:
            data = np.frombuffer(text, np.uint8)
            starts = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, np.arange(len(data)), 0))
            align = np.repeat(starts, WIDE[data])
            lead = len(MARK) * self.dummy_prefix
            return MARK[:lead] + text.replace(b" ", MARK), np.concatenate([np.zeros(lead, np.int64), align, [len(text)]])
        out, align, at, blank = bytearray(), [], 0, self.squeeze
        begun = False
        while at < len(text):
            new, size = self.chars.longest(text, at)
            if self.squeeze and not begun and new == b" ":
                at += size
                continue
            if not begun and self.dummy_prefix:
                out += MARK
                align += [at] * len(MARK)
            begun = True
            if blank:
                new = new.lstrip(b" ")
            if new:
                blank = self.squeeze and new.endswith(b" ")
                marked = new.replace(b" ", MARK)
                out += marked
                align += [at] * len(marked)
            at += size
        end = at
        while self.squeeze and out.endswith(MARK):
            del out[-len(MARK):]
            end = align[len(out)]
            del align[len(out):]
        return bytes(out), np.array([*align, end], np.int64)


@dataclass
class Vocabulary:
    """Sizes of the pieces in the normalized text, and their bytes in a decoded one."""

    sizes: np.ndarray
    starts: np.ndarray  # of each piece in ``data``
    lengths: np.ndarray
    data: np.ndarray
    is_byte: np.ndarray
    marked: np.ndarray  # pieces that begin with a mark
    shape: Shape


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Pieces(path).model.serialized_model_proto())
    if not proto.trainer_spec.byte_fallback:
        raise ValueError("a model without byte pieces merges unknown characters; their spans are not covered")
    norm = proto.normalizer_spec
    pieces = [(p.piece, p.type) for p in proto.pieces]
    plain = [t in (1, 4) for _, t in pieces]
    shown = {2: proto.trainer_spec.unk_surface.encode(), 3: b""}
    out = [p.replace(SPACE, " ").encode() if ok else bytes([int(p[3:5], 16)]) if t == 6 else shown.get(t, p.encode()) for (p, t), ok in zip(pieces, plain, strict=True)]
    lengths = np.array([len(x) for x in out])
    return Vocabulary(
        sizes=np.array([len(p.encode()) if ok else 1 for (p, _), ok in zip(pieces, plain, strict=True)]),
        starts=np.concatenate([[0], np.cumsum(lengths)[:-1]]),
        lengths=lengths,
        data=np.frombuffer(b"".join(out), np.uint8),
        is_byte=np.array([t == 6 for _, t in pieces]),
        marked=np.array([ok and p.startswith(SPACE) for (p, _), ok in zip(pieces, plain, strict=True)]),
        shape=Shape(CharMap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces),
    )


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Store:
    """An array that grows at its end by doubling, so adding costs what is added."""

    kind: type
    used: int = 0

    def __post_init__(self) -> None:
        self.data = np.zeros(1024, self.kind)

    def add(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[:self.used], np.zeros(max(self.used, 2 * len(values)), self.kind)])
        self.data[self.used:self.used + len(values)] = values
        self.used += len(values)


@dataclass
class Encoder:
    """Encodes pre-tokens once each; forgets them all when they grow over ``MEMO`` characters."""

    pieces: Pieces
    held: int = 0

    def __post_init__(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = Store(np.int32), Store(np.int64), Store(np.int64)

    def learn(self, tokens: list[str]) -> None:
        if self.held > MEMO:
            self.held = 0
            self.__post_init__()
        new = list({t for t in tokens if t not in self.place})
        if not new:
            return
        found = self.pieces.ids(new)
        sizes = np.array([len(x) for x in found])
        self.place.update(zip(new, range(self.starts.used, self.starts.used + len(new)), strict=True))
        self.starts.add(self.flat.used + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.flat.add(np.fromiter(chain.from_iterable(found), np.int32, sizes.sum()))
        self.held += sum(map(len, new))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a normalized text (spaces in place of marks)."""
        tokens = PRE_TOKEN.findall(text)
        self.learn(tokens)
        place = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        return self.flat.data[gathered(self.starts.data[place], self.sizes.data[place])]


def cuts(text: str) -> Iterator[str]:
    """Stretches of a text that begin at a pre-token: a space behind another character, or a line feed or tab."""
    border = re.compile(r"(?<! ) |[\n\t]")
    lo = 0
    while lo < len(text):
        at = border.search(text, lo + SLICE)
        hi = at.start() if at else len(text)
        yield text[lo:hi]
        lo = hi


def decoded(ids: np.ndarray, words: Vocabulary) -> str:
    """The text of a list of ids, as the library gives it: marks become spaces, the first of them goes; runs of byte pieces are
    read as UTF-8, with U+FFFD for each byte that does not fit."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return ""
    starts, sizes = words.starts[ids], words.lengths[ids]
    if words.shape.dummy_prefix and len(first := np.flatnonzero(sizes > 0)) and words.marked[ids[first[0]]]:
        starts[first[0]] += 1
        sizes[first[0]] -= 1
    data = words.data[gathered(starts, sizes)]
    if (words.lengths[ids] > 0).all():
        try:
            return data.tobytes().decode()
        except UnicodeDecodeError:
            pass
    # Runs of byte pieces that are no UTF-8, or end at a piece without a text: each run by itself.
    border = np.flatnonzero(np.diff(words.is_byte[ids].astype(np.int8))) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for lo, hi in zip([0, *border], [*border, len(ids)], strict=True):
        raw = data[at[lo]:at[hi]].tobytes()
        out.append(_lenient(raw) if words.is_byte[ids[lo]] else raw.decode())
    return "".join(out)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
            except UnicodeDecodeError:
                continue
            break
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def encode_text(text: str, encoder: Encoder, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text, and the byte offsets of their borders: piece i covers bytes borders[i] to borders[i + 1]."""
    normal, align = words.shape.normalize(text.encode())
    plain = normal.decode().replace(SPACE, " ")
    parts = [encoder.encode(part) for part in cuts(plain)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum(words.sizes[ids])])
    if at[-1] != len(normal):
        raise ValueError("pieces do not cover the normalized text")
    return ids, align[at].astype(np.int32) if len(ids) else np.zeros(0, np.int32)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else [], kind))


def encode_documents(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, ids, borders``: one row per input row; with ``decode`` also ``decoded``, the text that the ids give back.

    ``borders`` are byte offsets into the UTF-8 text, one more than there are ids: piece i covers ``borders[i]`` up to
    ``borders[i + 1]``. The mark that the model puts before a text covers nothing; a character in byte pieces lies in the last of
    them. Null and empty texts have no ids and no borders. Null ids and repeated rows each give their row; an empty table none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    pieces.check()
    docs = document(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, borders array<int>" + ", decoded string" * decode
    target = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = Encoder(pieces), vocabulary(pieces.path)

        def out(batch: pa.RecordBatch, lo: int, rows: list) -> pa.RecordBatch:
            cols = {"doc_id": batch.column("doc_id").slice(lo, len(rows)), "ids": lists([r[0] for r in rows], pa.int32()), "borders": lists([r[1] for r in rows], pa.int32())}
            return to_batch(cols | ({"decoded": [r[2] for r in rows]} if decode else {}), target)

        for batch in batches:
            rows, lo, held = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                ids, borders = encode_text(text.as_py() or "", encoder, words)
                rows.append((ids, borders, decoded(ids, words) if decode else None))
                held += len(ids)
                if held > TOKENS:
                    yield out(batch, lo, rows)
                    rows, lo, held = [], i + 1, 0
            yield out(batch, lo, rows)

    return docs.mapInArrow(run, schema)


def decode_documents(table: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of ids. A null list gives a null text; ids outside the vocabulary raise."""
    from .common import map_batches

    rows = document(table, id_col, ids_col)
    words = None

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        nonlocal words
        words = words or vocabulary(pieces.path)
        text = [None if x is None else decoded(np.array(x, np.int64), words) for x in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": text}

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
