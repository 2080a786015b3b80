"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, field by field, and rebuilt: the normaliser (precompiled map, dummy prefix, white
space rules), the metaspace marker, unigram scores or, for a BPE model, merges in the order of the scores, and byte
fallback. Batches are encoded by the library's threads. Where no piece holds a marker after another character, no piece
crosses the front of a run of markers; texts are then cut there, and the library encodes each stretch it has not met, so
a word costs once for many texts. Rebuilt and original are compared on texts of the table (``parity``), and every text is
decoded again to see whether it round-trips.

The model is a few hundred kilobytes, is read by the driver from a path that is a parameter, and travels with the
function. Cases: a null text has no ids and no flags; an empty text has an empty list and round-trips; whole texts are
encoded, however long; repeated rows come back alike; extra columns are not used.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message; groups don't occur in this format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size : at]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            raise ValueError(f"wire type {wire}")


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Every way in which two pieces make a third, ordered as the model merges: best score of the result first."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    score = {p: s for p, s, _ in m.pieces}
    found = []
    for whole, i in rank.items():
        for cut in range(1, len(whole)):
            left, right = whole[:cut], whole[cut:]
            if left in rank and right in rank:
                found.append((-score[whole], i, rank[left], rank[right], left, right))
    found.sort()
    return [x[4:] for x in found]


def build_tokenizer(m: Model):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges_of(m), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {m.kind} is not supported")
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    # where no piece has a marker after another character, no merge crosses the front of a run of markers
    if m.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    parts = [decoders.Replace(MARK, " ")]
    if m.byte_fallback:
        parts.append(decoders.ByteFallback())
    parts.append(decoders.Fuse())
    if m.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(parts)
    return t


def normal_text(m: Model, text: str) -> str:
    """The text that decoding can give back: without the white space that the model's rules remove."""
    if m.remove_extra:
        text = " ".join(x for x in text.split(" ") if x)
    return text


class Decoder:
    """Texts from ids, by joining pieces: markers become spaces, the one in front goes, runs of byte pieces become text.

    Gives what the library's decoder gives; bytes that are no UTF-8 become replacement characters, one each.
    """

    def __init__(self, m: Model):
        self.text = [p.replace(MARK, " ") for p, _, _ in m.pieces]
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE} if m.byte_fallback else {}
        self.strip = m.dummy_prefix

    def __call__(self, ids: list[int]) -> tuple[str, int]:
        """The text, and how many ids are bytes."""
        if self.bytes.keys().isdisjoint(ids):
            text, n = "".join(map(self.text.__getitem__, ids)), 0
        else:
            parts: list[str] = []
            held = bytearray()
            n = 0

            def flush() -> None:
                if held:
                    try:
                        parts.append(held.decode())
                    except UnicodeDecodeError:
                        parts.append("\ufffd" * len(held))
                    held.clear()

            for i in ids:
                b = self.bytes.get(i)
                if b is None:
                    flush()
                    parts.append(self.text[i])
                else:
                    held.append(b)
                    n += 1
            flush()
            text = "".join(parts)
        return (text[1:] if self.strip and text.startswith(" ") else text), n


class Encoder:
    """Ids of texts by the rebuilt tokenizer, through a table of the stretches between fronts of runs of markers.

    The table holds at most ``limit`` stretches of at most ``longest`` characters, and starts anew beyond that. A model
    whose pieces cross those fronts is applied to whole texts.
    """

    def __init__(self, m: Model, limit: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.m, self.whole, self.limit, self.longest = m, build_tokenizer(m), limit, longest
        self.cut = self.whole.pre_tokenizer is not None
        self.parts = Tokenizer(self.whole.model)
        self.known: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """The normalised text cut before each run of markers."""
        if self.m.charsmap or self.m.remove_extra or not self.m.dummy_prefix:
            text = self.whole.normalizer.normalize_str(text)
            return [x for x in _FRONTS.findall(text)]
        words = text.replace(" ", MARK).split(MARK)
        if "" in words:
            return _FRONTS.findall(MARK + MARK.join(words))
        return [MARK + w for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers in a row: bytes, so that a large table costs no garbage collection."""
        packed = lambda e: array("i", e.ids).tobytes()
        if not self.cut:
            return [packed(e) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.stretches(x) if x else [] for x in texts]
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, map(packed, self.parts.encode_batch_fast(new, add_special_tokens=False))))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        if len(known) > self.limit:
            known.clear()
        else:
            for c in new:
                if len(c) > self.longest:
                    del known[c]
        return out


_FRONTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_cache: dict[int, tuple] = {}


def _ready(data: bytes) -> tuple:
    key = hash(data)
    if key not in _cache:
        m = parse_model(data)
        encoder = Encoder(m)
        _cache[key] = (m, encoder.whole, Decoder(m), encoder)
    return _cache[key][:3]


def _encoder(data: bytes) -> Encoder:
    _ready(data)
    return _cache[hash(data)][3]


ENCODED = "doc_id long, input_ids array<int>, n_tokens long, n_bytes_fallback long, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model_path: str, *, parity_every: int = 64, batch_chars: int = 400_000, threads: int = 2) -> DataFrame:
    """doc_id, input_ids, n_tokens, n_bytes_fallback, round_trip, parity of every row.

    parity compares with the original library, for rows whose id is divisible by ``parity_every`` or null (null elsewhere); it
    is a check of the rebuilt model, not part of the encoding. ``threads`` bounds the library's threads in a worker.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        (m, _, decoder), encoder = _ready(data), _encoder(data)
        original = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= batch_chars):
                    size += len(texts[end] or "")
                    end += 1
                part, keys = texts[at:end], ids[at:end]
                packed = [f if x else b"" for x, f in zip(part, encoder([x or "" for x in part]))]
                flat = np.frombuffer(b"".join(packed), np.int32)
                found = [np.frombuffer(f, np.int32).tolist() for f in packed]
                back = [decoder(f) for f in found]
                null = np.array([x is None for x in part])
                counts = np.array([len(f) for f in found], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                wanted = [None if x is None else normal_text(m, x) if not m.charsmap else original.normalize(x).replace(MARK, " ").removeprefix(" ") for x in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(flat)),
                        pa.array(counts, pa.int64(), mask=null),
                        pa.array([n for _, n in back], pa.int64(), mask=null),
                        pa.array([None if w is None else w == b for w, (b, _) in zip(wanted, back)], pa.bool_()),
                        pa.array([original.encode(x) == f if x is not None and (i or 0) % parity_every == 0 else None for i, x, f in zip(keys, part, found)], pa.bool_()),
                    ],
                    names=["doc_id", "input_ids", "n_tokens", "n_bytes_fallback", "round_trip", "parity"],
                )
                at = end

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def decode_documents(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from doc_id and input_ids; null for null."""
    with open(model_path, "rb") as f:
        data = f.read()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _ready(data)[2]
        for batch in batches:
            texts = [None if x is None else decoder(x)[0] for x in batch.column("input_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "input_ids").mapInArrow(decode, "doc_id long, text string")


def ids_digest(column: str = "input_ids"):
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), ","), 256)
