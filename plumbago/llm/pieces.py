"""SentencePiece models on the tokenizers library: encode, decode, compare.

The model's protobuf is parsed here (its few fields that matter), and the
normaliser, the space marker, the scores and the byte fallback are rebuilt in
the tokenizers library. Unigram models keep their scores; for BPE models the
merges are all splits of each piece into two pieces, ranked by the piece's
score. Texts are split before each run of markers where no piece crosses such a
place, which changes nothing in the result and lets words be cached. Parity with
the sentencepiece library is verified for every word (or text, where texts
aren't split) that is encoded.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, named, schema_with, slices, span_hashes, texts_of, tune

MARK = "▁"
#: Fixed values of the model file's format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Fixed(bytes):
    """A protobuf value of fixed size."""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, Fixed(data[at : at + n])
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    unk_id: int = 0


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding needs."""
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
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
    m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    return m


def build(m: Model):
    """A tokenizers.Tokenizer with the model's ids.

    In a unigram model only ordinary and user-defined pieces can be found in a
    text; the others get names with a space, which no normalised text has. What
    remains unknown is spelled in bytes afterwards (see Encoder).
    """
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    usable = {p for p, _, k in m.pieces if k in (NORMAL, USER)}
    if m.kind == UNIGRAM:
        top = max((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        scored = [
            (p, s) if k == NORMAL else (p, len(p.encode()) * top - 0.1) if k == USER else (f" {i}", top) for i, (p, s, k) in enumerate(m.pieces)
        ]
        model = models.Unigram(scored, m.unk_id, False)
    elif m.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        merges = []
        for i, (p, s, k) in enumerate(m.pieces):
            if k in (NORMAL, USER):
                merges += [(-s, i, j, p[:j], p[j:]) for j in range(1, len(p)) if p[:j] in usable and p[j:] in usable]
        merges = [(a, b) for *_, a, b in sorted(merges)]
        model = models.BPE(ids, merges, unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=1 << 14)
    else:
        raise ValueError(f"model type {m.kind}")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    return t


def build_decoder(m: Model):
    """A tokenizers.Tokenizer that decodes the model's ids; the space that stands for the dummy prefix goes."""
    from tokenizers import Tokenizer, decoders, models

    t = Tokenizer(models.WordLevel({p: i for i, (p, _, _) in enumerate(m.pieces)}, unk_token=m.pieces[m.unk_id][0]))
    last = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return t


class Encoder:
    """A worker's tokenizer, with the token ids of words it has seen.

    Where texts are split before markers anyway and the normaliser only
    replaces spaces, equal words have equal ids: words not seen before are
    encoded in one multithreaded batch, and a text's ids are gathered. Other
    models encode whole texts in multithreaded batches. With `verify`, what is
    encoded is also encoded by sentencepiece and compared.
    """

    MOST = 500_000

    def __init__(self, data: bytes, verify: bool = False):
        from tokenizers import normalizers

        self.model = m = parse(data)
        self.tokenizer = build(m)
        self.by_word = self.tokenizer.pre_tokenizer is not None and not m.charsmap and not m.remove_extra_whitespaces
        self.prefix = b" " if m.add_dummy_prefix else b""
        self.decoder = build_decoder(m)
        self.spelled = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(m.pieces) if k == BYTE} if m.byte_fallback and m.kind == UNIGRAM else {}
        self.known = None
        if verify:
            import sentencepiece

            self.known = sentencepiece.SentencePieceProcessor(model_proto=data)
        if self.spelled or self.by_word:
            self.normalizer = self.tokenizer.normalizer
            self.tokenizer.normalizer = normalizers.Sequence([])
        if self.by_word:
            self.bytes = [_piece_bytes(p, k) for p, _, k in m.pieces]
            self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
            self.places = np.cumsum(self.sizes) - self.sizes
            self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
            self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.counts, self.good = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts (or words, with markers), in one multithreaded batch."""
        if not self.spelled:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = texts if self.by_word else [self.normalizer.normalize_str(t) if t else "" for t in texts]
        out, unknown = [], self.model.unk_id
        for t, e in zip(plain, self.tokenizer.encode_batch(plain, add_special_tokens=False)):
            if unknown in e.ids:
                spelled = ((self.spelled[c] for c in t[a:b].encode()) if i == unknown else (i,) for i, (a, b) in zip(e.ids, e.offsets))
                out.append(list(itertools.chain.from_iterable(spelled)))
            else:
                out.append(e.ids)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text, whether the text has passed all comparisons: true where none are made)."""
        if not self.by_word:
            strings = [t.decode() for t in texts]
            got = self._batch(strings)
            counts = np.fromiter(map(len, got), np.int64, len(got))
            same = np.ones(len(texts), bool)
            if self.known is not None:
                same[:] = [x == y for x, y in zip(got, self.known.encode(strings, num_threads=1))]
            return np.fromiter(itertools.chain.from_iterable(got), np.int32, counts.sum()), counts, same
        if len(self.keys) > self.MOST:
            self.forget()
        # a word begins with a run of spaces; one that is written with markers counts as the same
        parts = [self.prefix + t.replace(MARK.encode(), b" ") if t else t for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        space = data == 32
        begins = np.append(True, ~space[:-1]) & space if len(data) else space.copy()
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        names, place, where = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, names), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[spot] != names) if len(self.keys) else np.arange(len(names))
        if len(new):
            for part in np.split(new, range(BATCH, len(new), BATCH)):
                self._learn(names[part], [data[starts[k] : ends[k]].tobytes().decode().replace(" ", MARK) for k in place[part]])
            spot = np.searchsorted(self.keys, names)
        at = self.at[spot][where] if len(names) else np.zeros(0, np.int64)
        text = np.searchsorted(np.cumsum(sizes), starts, side="right")
        same = np.bincount(text[~self.good[at]], minlength=len(texts)) == 0
        return self.ids[gather(self.starts[at], self.counts[at])], np.bincount(text, weights=self.counts[at], minlength=len(texts)).astype(np.int64), same

    def _learn(self, names: np.ndarray, words: list[str]) -> None:
        got = self._batch(words)
        counts = np.fromiter(map(len, got), np.int64, len(got))
        good = np.ones(len(words), bool)
        if self.known is not None:
            good[:] = self._alike(words, got)
        at = np.arange(len(self.counts), len(self.counts) + len(words))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.good = np.concatenate([self.counts, counts]), np.concatenate([self.good, good])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.int32, counts.sum())])
        where = np.searchsorted(self.keys, names)
        self.keys, self.at = np.insert(self.keys, where, names), np.insert(self.at, where, at)

    def _alike(self, words: list[str], got: list[list[int]]) -> list[bool]:
        """Whether sentencepiece gives the same ids: for all words as one text, as it splits where words do, and only if not for each one."""
        plain, cut = [w.replace(MARK, " ") for w in words], len(self.prefix)
        if all(w.strip(MARK) for w in words) and self.known.encode("".join(plain)[cut:]) == list(itertools.chain.from_iterable(got)):
            return [True] * len(words)
        # a space alone is an empty text with its prefix, which sentencepiece gives no ids: its one piece is looked up
        want = [y if w[cut:] else [self.known.piece_to_id(MARK)] for w, y in zip(plain, self.known.encode([w[cut:] for w in plain], num_threads=1))]
        return [x == y for x, y in zip(got, want)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, the dummy prefix included; for models by word."""
        return self.flat[gather(self.places[ids], self.sizes[ids])].tobytes()

    def round_trips(self, texts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> list[bool]:
        if not self.by_word:
            parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            back = self.decoder.decode_batch([p.tolist() for p in parts], skip_special_tokens=False)
            return [x == y.encode() for x, y in zip(texts, back)]
        out, at = self.decode_bytes(ids), 0
        sizes = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=sizes[1:])
        ends = sizes[np.cumsum(counts)]
        same = []
        for text, end in zip(texts, ends.tolist()):
            whole = out[at:end]
            same.append(whole == (self.prefix + text if text else text))
            at = end
        return same


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the spans [start, start + count), one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _piece_bytes(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[1:-1], 16)])
    return piece.replace(MARK, " ").encode()


_encoders: dict[tuple, Encoder] = {}
#: Words that are encoded in one batch.
BATCH = 4096


def encoder(data: bytes, threads: int, verify: bool = False) -> Encoder:
    """One a worker process and model."""
    import os

    key = hashlib.sha256(data).digest(), verify
    if key not in _encoders:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        _encoders[key] = Encoder(data, verify)
    return _encoders[key]


def read_model(path: str, max_bytes: int = 64 << 20) -> bytes:
    """The driver reads the model file; its size is checked, since tasks get a copy."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} is over {max_bytes} bytes")
    return data


def as_unigram(data: bytes) -> bytes:
    """A model file of merges as a unigram model: the same pieces, their ranks as log-probabilities by Zipf's law, the model type changed."""
    out = b""
    for number, value in _fields(data):
        if number == 1:
            parts = dict(_fields(value))
            if parts.get(3, NORMAL) == NORMAL:
                parts[2] = Fixed(struct.pack("<f", -math.log(math.e - struct.unpack("<f", parts.get(2, Fixed(4)))[0])))
            value = b"".join(_field(n, v) for n, v in sorted(parts.items()))
        elif number == 2:
            value = b"".join(_field(n, v) for n, v in _fields(value) if n != 3) + _field(3, UNIGRAM)
        out += _field(number, value)
    return out


def _field(number: int, value: int | bytes) -> bytes:
    """A field of a protobuf message; bytes of a fixed size (4 or 8, in the fields that have it) keep their kind."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, Fixed):
        return varint(number << 3 | {8: 1, 4: 5}[len(value)]) + value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _share(spark: SparkSession, model: str | bytes):
    tune(spark)
    return spark.sparkContext.broadcast(model if isinstance(model, bytes) else read_model(model))


def encode(
    df: DataFrame, model: str | bytes, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: bool = True
) -> DataFrame:
    """(id, n_tokens long, ids array<int>, round_trip boolean, same boolean) for each row. model: a path, or the file's bytes.

    round_trip: decoding the ids gives the text back. same: sentencepiece gives
    the same ids, compared for each word that the worker meets (for each text,
    where texts aren't split); null without `verify`. Where two splits of a
    unigram model have equal scores, the libraries may choose differently. A null text has null ids,
    no tokens and nulls for both; an empty text has an empty array. Repeated
    rows and null ids are encoded each on their own; texts are encoded whole; an
    empty table gives an empty result. Other columns are ignored.
    """
    shared = _share(df.sparkSession, model)

    def run(batches):
        give_back()
        e = encoder(shared.value, threads, verify)
        for batch in batches:
            texts, none = texts_of(batch.column(1)), ~np.array(batch.column(1).is_valid())
            for a, b in slices(texts):
                ids, counts, alike = e.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)])
                trip = pa.array(e.round_trips(texts[a:b], ids, counts), pa.bool_(), mask=none[a:b])
                same = pa.array(alike, pa.bool_(), mask=none[a:b] if verify else np.ones(b - a, bool))
                offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(none[a:b], False))
                cols = [batch.column(0).slice(a, b - a), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids)), trip, same]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids", "round_trip", "same"])
        give_back()

    schema = schema_with(df, [id_col], "n_tokens long, ids array<int>, round_trip boolean, same boolean")
    return df.select(named(id_col), named(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str | bytes, *, id_col: str = "doc_id", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """(id, text) from token ids, by the tokenizers library's decoder in multithreaded batches.

    Null ids give a null text, an empty array an empty one; nulls in an array
    and ids outside the vocabulary stand for nothing. Repeated rows and null row
    ids are decoded each on their own. Empty table: empty result. Other columns
    are ignored.
    """
    shared = _share(df.sparkSession, model)

    def run(batches):
        e = encoder(shared.value, threads)
        most = len(e.model.pieces)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = e.decoder.decode_batch([[i for i in x or [] if i is not None and 0 <= i < most] for x in ids], skip_special_tokens=False)
            out = pa.array([None if i is None else x for i, x in zip(ids, back)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [id_col, "text"])
        give_back()

    return df.select(named(id_col), named(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, schema_with(df, [id_col], "text string"))


def parity(df: DataFrame, model: str | bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same boolean): whether sentencepiece gives the same ids for the whole text, for every row (null text: null; empty table: empty result)."""
    shared = _share(df.sparkSession, model)

    def run(batches):
        import sentencepiece

        e = encoder(shared.value, 2)
        known = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            texts, none = texts_of(batch.column(1)), ~np.array(batch.column(1).is_valid())
            for a, b in slices(texts):
                ids, counts, _ = e.encode(texts[a:b])
                parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
                same = [p.tolist() == i for p, i in zip(parts, known.encode([t.decode() for t in texts[a:b]], num_threads=1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(same, pa.bool_(), mask=none[a:b])], [id_col, "same"])
        give_back()

    return df.select(named(id_col), named(text_col).cast("string").alias("__text")).mapInArrow(run, schema_with(df, [id_col], "same boolean"))
