"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file's protobuf is read directly: pieces with scores and kinds, the model type, byte
fallback and the normaliser's settings. From them a ``tokenizers`` pipeline is built: the
compiled character map, blank handling, the dummy prefix, the marker for blanks, and either the
unigram model with its scores or, for BPE models, the merges that the scores imply (a pair of
adjacent pieces merges if the joined string is a piece, higher scores first), with bytes for what
the pieces do not cover. Where no piece continues across a blank, texts are cut in front of
blanks, which changes no id: the distinct words of a batch are encoded together, and a worker
remembers their ids.

Everything is verified against the ``sentencepiece`` library: each distinct word when a worker first
meets it, and every text that is not cut into words, or holds a word on which the two differ, as a
whole; that library's ids count where they differ. A word is also decoded once, so that a text
decodes to itself if its words do. Null texts are empty, give no pieces and decode to the empty text. Rows need no
unique ids, and other columns pass through untouched.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tablecare.llm.frames import append_columns, extended, fresh
from tablecare.llm.textnum import text_column

MARKER = "▁"
# Fixed values of the model file's format: kinds of pieces and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH = 256
# Words whose ids a worker process remembers; it starts over when there are more.
REMEMBERED_WORDS = 800_000


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, four or eight bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True
    escape_blanks: bool = True


def read_model(path: str) -> PieceModel:
    model = PieceModel()
    with open(path, "rb") as file:
        data = file.read()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for part, v in fields(value):
                if part == 1:
                    piece = v.decode()
                elif part == 2:
                    score = struct.unpack("<f", v)[0]
                elif part == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == 2:
            spec = dict(fields(value))
            model.model_type, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_extra_blanks = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            model.escape_blanks = bool(spec.get(5, 1))
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """All pairs of pieces that join to a piece, the better pieces first."""
    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
    order = sorted(usable.values(), key=lambda i: (-model.scores[i], i))
    found = []
    for i in order:
        piece = model.pieces[i]
        splits = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
        found += sorted((s for s in splits if s[0] in usable and s[1] in usable), key=lambda s: (usable[s[0]], usable[s[1]]))
    return found


def build_tokenizer(model: PieceModel) -> Tokenizer:
    unknown = model.kinds.index(UNKNOWN)
    if model.model_type == UNIGRAM:
        scored = list(zip(model.pieces, model.scores, strict=True))
        core = models.Unigram(scored, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        vocabulary = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(
            vocabulary, merges(model), unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback,
            cache_capacity=200_000,
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    blank = MARKER if model.escape_blanks else " "
    if not any(blank in p.lstrip(blank) for p in model.pieces):
        words = Regex(f"{blank}+[^{blank}]*|[^{blank}]+")
        tokenizer.pre_tokenizer = pre_tokenizers.Split(words, behavior="isolated")
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else back)
    return tokenizer


class PieceCodec:
    """Both libraries on one model file."""

    def __init__(self, path: str):
        self.model = read_model(path)
        self.tokenizer = build_tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])
        self.by_word = build_tokenizer(self.model)
        self.by_word.normalizer = normalizers.Sequence([])
        m = self.model
        # words can be encoded one by one where they are cut and written exactly like this
        self.cuts = self.by_word.pre_tokenizer is not None and m.dummy_prefix and m.escape_blanks
        # (a unigram model weighs the whole text, and equal sums may fall either way)
        self.cuts = self.cuts and not m.charsmap and not m.remove_extra_blanks and m.model_type == BPE
        self.words: dict[str, bytes] = {}
        # words on which the libraries differ, and words that do not decode to themselves
        self.differing: set[str] = set()
        self.unfaithful: set[str] = set()

    def _plain(self, text: str) -> bool:
        """Is every blank of the text single and between words?"""
        return self.cuts and text != "" and text[0] != " " and text[-1] != " " and "  " not in text and MARKER not in text

    def _learn(self, split: list[list[str]]) -> None:
        """Ids of words not met before, from both libraries, and whether they decode to the word."""
        new = list(set().union(*split).difference(self.words))
        if len(self.words) + len(new) > REMEMBERED_WORDS:
            self.words.clear(), self.differing.clear(), self.unfaithful.clear()
            new = list(set().union(*split))
        coded = [e.ids for e in self.by_word.encode_batch_fast([MARKER + w for w in new], add_special_tokens=False)]
        self.words.update((w, np.asarray(c, "<u4").tobytes()) for w, c in zip(new, coded, strict=True))
        expected = self.reference.encode(new, num_threads=1)
        self.differing.update(w for w, c, e in zip(new, coded, expected, strict=True) if c != e)
        back = self.tokenizer.decode_batch(coded, skip_special_tokens=False)
        self.unfaithful.update(w for w, t in zip(new, back, strict=True) if w != t)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of each text, whether both libraries agreed on it, and whether it decodes to itself."""
        ids: list = [None] * len(texts)
        parity, faithful = [True] * len(texts), [True] * len(texts)
        plain = {i: t.split(" ") for i, t in enumerate(texts) if self._plain(t)}
        self._learn(list(plain.values()))
        if self.differing:
            plain = {i: words for i, words in plain.items() if self.differing.isdisjoint(words)}
        find = self.words.__getitem__
        for i, words in plain.items():
            ids[i] = np.frombuffer(b"".join(map(find, words)), "<u4")
            faithful[i] = not self.unfaithful or self.unfaithful.isdisjoint(words)
        rest = [i for i in range(len(texts)) if i not in plain]
        hard = [texts[i] for i in rest]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
        expected = self.reference.encode(hard, num_threads=1) if hard else []
        back = self.tokenizer.decode_batch(expected, skip_special_tokens=False)
        for i, c, e, t in zip(rest, coded, expected, back, strict=True):
            ids[i], parity[i], faithful[i] = np.asarray(e, "<u4"), c == e, t == texts[i]
        return ids, parity, faithful

    def decode(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch([np.asarray(i).tolist() for i in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> PieceCodec:
    """One codec per model file and worker process; ``threads`` counts where this process has not encoded before."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    return PieceCodec(path)


def encode_pieces(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", threads: int = 2
) -> DataFrame:
    """``docs`` with the piece ids of each text (``fresh`` renames on a clash)."""
    ids = fresh(docs.columns, ids)

    def encoded(batches):
        own = codec(model_path, threads)
        for batch in batches:
            texts = text_column(batch, text)
            for lo in range(0, len(batch), BATCH):
                got, _, _ = own.encode(texts[lo : lo + BATCH].to_pylist())
                lists = pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))
                yield append_columns(batch.slice(lo, BATCH), **{ids: lists})

    return docs.mapInArrow(encoded, extended(docs.schema, **{ids: T.ArrayType(T.IntegerType())}))


def decode_pieces(frame: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """``frame`` with the text of each list of ids; a null list gives the empty text."""
    text = fresh(frame.columns, text)

    def decoded(batches):
        own = codec(model_path, threads)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for lo in range(0, len(batch), BATCH):
                texts = own.decode([v or [] for v in column[lo : lo + BATCH].to_pylist()])
                yield append_columns(batch.slice(lo, BATCH), **{text: pa.array(texts, pa.string())})

    return frame.mapInArrow(decoded, extended(frame.schema, **{text: T.StringType()}))


def piece_summary(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """Per row: doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit ids), parity and round_trip.

    ``round_trip`` tells whether the ids decode to the text itself, ``parity`` whether both
    libraries gave the same ids.
    """
    plain = docs.select(doc_id, text).toDF("doc_id", "text")

    def summed(batches):
        own = codec(model_path, threads)
        for batch in batches:
            texts = text_column(batch, "text")
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            for lo in range(0, len(batch), BATCH):
                part = texts[lo : lo + BATCH].to_pylist()
                arrays, parity, faithful = own.encode(part)
                columns = [
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([int(own.is_byte[a].sum()) for a in arrays], pa.int64()),
                    pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64()),
                    pa.array(parity, pa.bool_()),
                    pa.array(faithful, pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "parity", "round_trip"]
                yield pa.RecordBatch.from_arrays([keys[lo : lo + BATCH], *columns], names=names)

    id_type = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_pieces long, n_byte_pieces long, ids_crc32 long, parity boolean, round_trip boolean"
    return plain.mapInArrow(summed, schema)
