"""Operator 7: byte-level BPE by way of a sentencepiece model made from the vocabulary.

The ranks of a byte-level vocabulary become a sentencepiece BPE model without any training: each token's bytes are mapped
to one printable character a byte, its score is its negative rank, and normalisation is the identity without dummy
prefix or white-space escapes. Merging the pair of the best score is then merging the pair of the lowest rank, so the
model, given one pre-token at a time, yields the ids of the byte-level encoder. Decoding maps pieces back to bytes.

The model message is written field by field in the protobuf wire format; it is made in each process from the vocabulary
file and never stored.

Scale: no shuffle. Texts are cut into pre-tokens in the tasks; distinct pre-tokens of a batch are encoded once, and a
bounded dictionary keeps what came first, which are the frequent ones.

Defined cases: null text is empty, has no ids and decodes to nothing; repeated rows repeat their result; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumencat.llm.common import pieces, table, texts

RANKS = "byte_bpe_50k.tiktoken"
KEEP_PRETOKENS = 600_000
BATCH_BYTES = 8 << 20

# Fixed values of the sentencepiece model format: field numbers, piece types and the BPE model type.
PIECES, TRAINER_SPEC, NORMALIZER_SPEC = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable in Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from lines of base64 and rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [found[r] for r in range(len(found))]


def _varint(n: int) -> bytes:
    if n < 0:
        n += 1 << 64
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialized_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows them."""
    char = byte_characters()
    out = [_bytes(PIECES, _bytes(PIECE, "".join(char[b] for b in t).encode()) + _float(SCORE, -float(rank)) + _number(TYPE, NORMAL)) for rank, t in enumerate(tokens)]
    out.append(_bytes(PIECES, _bytes(PIECE, b"<unk>") + _float(SCORE, 0.0) + _number(TYPE, UNKNOWN)))
    n = len(tokens)
    out.append(_bytes(TRAINER_SPEC, _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, n + 1) + _number(UNK_ID, n) + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1)))
    out.append(_bytes(NORMALIZER_SPEC, _bytes(NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0) + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0)))
    return b"".join(out)


class PieceCodec:
    """encode: ids of each text; decode: bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def mapped(self, pretoken: str) -> str:
        return pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map)

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        learnt = dict(zip(new, self.model.encode([self.mapped(p) for p in new], num_threads=1), strict=True)) if new else {}
        if len(self.known) + len(learnt) <= KEEP_PRETOKENS:
            self.known.update(learnt)
            get = self.known.__getitem__
        elif not learnt:
            get = self.known.__getitem__
        else:
            first, then = self.known.get, learnt.__getitem__
            get = lambda p: first(p) or then(p)
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], PieceCodec] = {}


def codec(path: str, pattern: str) -> PieceCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = PieceCodec(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Returns (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]); the digests are of the decimal ids joined by a space and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        name = c.names.__getitem__
        for whole in batches:
            for b in pieces(iter([whole]), BATCH_BYTES, "text"):
                found = c.encode(b.column("text").to_pylist())
                columns = [
                    b.column("doc_id"),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest() for ids in found]),
                    pa.array([hashlib.sha256(c.decode(ids)).hexdigest() for ids in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(found, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
