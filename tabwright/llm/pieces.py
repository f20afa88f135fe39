"""SentencePiece models on the tokenizers library: encoding, decoding and a check of parity.

The model file is a protobuf message, read here field by field: pieces with scores and types, the model type
and the normaliser. They are rebuilt as a Unigram model, or as a BPE model whose merges are all splits of
a piece into two pieces in order of its score; with byte fallback, the metaspace mark and a normaliser from
the compiled character map where there is one.

If no piece has the mark behind another character, and the normaliser changes nothing else, a text can be cut
in front of every run of spaces, and a batch encodes each different chunk once, on all threads of the
library. Every different chunk is also encoded by the sentencepiece library and decoded again: ``parity``
says that both libraries agree on all chunks of a text, ``round_trip`` that decoding gives the text back (with
marks as spaces). Other models are encoded and checked text by text.

Defined cases: a null or empty text has no ids; repeated rows get equal results.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm import chunks
from tabwright.llm.arrays import slices
from tabwright.llm.rows import arrow_schema, ddl, extended, free_name, lean

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


def _fields(message: bytes):
    """(number, value) of each field: integers, or bytes of the other wire types."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, message[at:at + size]
        at += size


@dataclass
class PieceModel:
    """What the model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @staticmethod
    def parse(content: bytes) -> PieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(content):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        return PieceModel(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
                          bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))

    @cached_property
    def cuttable(self) -> bool:
        plain = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        return (self.dummy_prefix and self.escape and not self.remove_extra and not self.charsmap
                and not any(re.search(f"[^{MARK}]{MARK}", p) or " " in p for p in plain)
                and not any(kind == USER_DEFINED for _, _, kind in self.pieces))

    def token_bytes(self) -> np.ndarray:
        """The bytes of text that each id stands for, with a space for a mark."""
        return np.array([1 if kind == BYTE else len(p.replace(MARK, " ").encode()) if kind in (NORMAL, USER_DEFINED) else 0
                         for p, _, kind in self.pieces])

    def merges(self) -> list[tuple[str, str]]:
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind in (NORMAL, USER_DEFINED):
                for cut in range(1, len(piece)):
                    left, right = piece[:cut], piece[cut:]
                    if left in rank and right in rank:
                        found.append((-score, rank[piece], rank[left], rank[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def tokenizer(self, prefix: bool):
        """The model on the tokenizers library; without the prefix, texts already begin with a space."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), fuse_unk=True,
                               unk_token=self.pieces[unknown][0], byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if prefix and self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        made = Tokenizer(model)
        made.normalizer = normalizers.Sequence(steps)
        if not prefix:
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        strip = [decoders.Strip(content=" ", left=1)] if prefix and self.dummy_prefix else []
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return made


RESULT = {"n_pieces": "bigint", "ids_crc32": "bigint", "parity": "boolean", "round_trip": "boolean"}


def _encoder(model_path: str) -> chunks.Encoder:
    """An encoder with two checks: parity with the other library, and decoding to the same text."""
    import sentencepiece

    chunks.limit_threads()
    with open(model_path, "rb") as file:
        model = PieceModel.parse(file.read())
    tokenizer = model.tokenizer(prefix=not model.cuttable)
    other = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def tokenize(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def check(texts, lists):
        # the other library adds the prefix itself, but not to an empty text: a lone space is a lone mark
        plain = [t[1:] for t in texts] if model.cuttable else texts
        expected = [ids or [other.piece_to_id(MARK)] for ids in other.encode(plain, num_threads=1)]
        back = tokenizer.decode_batch(lists, skip_special_tokens=False)
        return np.array([[a != b for a, b in zip(lists, expected)],
                         [a != b.replace(MARK, " ") for a, b in zip(back, texts)]], bool)

    made = chunks.Encoder(tokenize, model.token_bytes() if model.cuttable else None, check, checks=2)
    made.model = model
    return made


def _encoding(model_path: str, with_ids: bool):
    """For ``mapInArrow``: the columns of each batch but the text, then those of RESULT, then the ids."""

    def run(batches):
        kept = chunks.kept_encoder(model_path, lambda: _encoder(model_path))
        model = kept.model
        for batch in batches:
            for texts in slices(batch.column("text"), chunks.SLICE_BYTES):
                if model.cuttable:
                    # every text that isn't empty gets the space that stands for its prefix
                    filled = np.diff(texts.offsets) > 0
                    data = np.insert(texts.data, texts.offsets[:-1][filled], 32)
                    offsets = texts.offsets + np.concatenate([[0], np.cumsum(filled)])
                    starts = chunks.space_starts(data, offsets)
                else:
                    data, offsets = texts.data, texts.offsets
                    starts = offsets[:-1][np.diff(offsets) > 0]
                ids, begins, failed = kept.encode(data, offsets, starts)
                plain_ids = ids.astype("<u4")
                sums = [zlib.crc32(plain_ids[a:b].tobytes()) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
                rows = batch.slice(texts.first, texts.rows)
                found = [pa.array(np.diff(begins)), pa.array(sums, pa.int64()),
                         *(pa.array(f == 0) for f in failed)]
                if with_ids:
                    found.append(pa.ListArray.from_arrays(begins.astype(np.int32), ids.astype(np.int32)))
                yield rows, found

    return run


IDS = {"piece_ids": "array<int>"}


def encode(docs: DataFrame, model_path: str, columns: dict[str, str], with_ids: bool = False) -> DataFrame:
    """The named columns (name: type) with n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), parity and round_trip, and the ids themselves if wanted (``piece_ids``)."""
    result = columns | RESULT | (IDS if with_ids else {})
    schema, work = arrow_schema(result), _encoding(model_path, with_ids)

    def run(batches):
        for rows, found in work(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *found], schema=schema)

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(lean(run), ddl(result))


def encode_all_columns(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs``, then piece_ids and those of ``encode``, under other names where these are taken."""
    added = {free_name(docs, n): kind for n, kind in (RESULT | IDS).items()}
    extra, work = list(arrow_schema(added)), _encoding(model_path, True)

    def run(batches):
        for rows, found in work(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, *found], schema=pa.schema([*rows.schema, *extra]))

    return docs.mapInArrow(lean(run), extended(docs, added))


def decode(encoded: DataFrame, model_path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns with ``decoded``, the text of ``piece_ids``."""
    result = columns | {"decoded": "string"}
    schema = arrow_schema(result)

    def run(batches):
        with open(model_path, "rb") as file:
            tokenizer = PieceModel.parse(file.read()).tokenizer(prefix=True)
        for batch in batches:
            texts = tokenizer.decode_batch(batch.column("piece_ids").fill_null([]).to_pylist(), skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(*dict.fromkeys([*columns, "piece_ids"])).mapInArrow(lean(run), ddl(result))
