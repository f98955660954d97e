"""SentencePiece encoding with source offsets, and decoding.

Normalisation takes, at each place, the longest prefix that the model's compiled
character map knows, and records which source bytes each normalised byte came
from; pieces of the normalised text are projected back through that record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SPACE = "▁"
_SPACE = SPACE.encode()


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 and the
    replacement strings that its values point into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest known prefix of data[at:]."""
        units = self.units
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        found = None
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (n + 1 - at, value)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class Normalizer:
    """Text -> (normalised bytes, source offset of every normalised byte)."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.plain = not self.map.units
        self.prefix = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces

    def _pieces(self, data: bytes):
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, at + step, data[at : at + step]
                at += step
            else:
                yield at, at + hit[0], hit[1]
                at += hit[0]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Offsets have one entry more than the bytes: the source's length (or,
        where trailing spaces were removed, the end of what was kept)."""
        data = text.encode("utf-8")
        space = _SPACE if self.escape else b" "
        if self.plain and not self.trim:
            return self._simple(data, space)
        parts = list(self._pieces(data))
        end = len(data)
        if self.trim:
            k = 0
            while k < len(parts) and parts[k][2] in (b" ", b""):
                k += 1
            parts = parts[k:]
        out, src = bytearray(), []
        if parts and self.prefix:
            out += space
            src += [parts[0][0]] * len(space)
        was_space = self.trim
        for a, b, new in parts:
            if self.trim and was_space:
                new = new.lstrip(b" ")
            if new:
                was_space = new.endswith(b" ")
                for byte in new:
                    x = space if byte == 0x20 else bytes([byte])
                    out += x
                    src += [a] * len(x)
            elif not self.trim:
                was_space = False
            end = b
        if self.trim:
            while out.endswith(space):
                end = src[len(out) - len(space)]
                del out[-len(space) :], src[-len(space) :]
        src.append(end)
        return bytes(out), np.array(src, dtype=np.int64)

    def _simple(self, data: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        width = np.where(raw == 0x20, len(space), 1)
        src = np.repeat(np.arange(len(raw)), width)
        text = data.replace(b" ", space)
        if self.prefix:
            text = space + text
            src = np.concatenate((np.zeros(len(space), np.int64), src))
        return text, np.append(src, len(raw))


class Encoder:
    """Encodes exactly as the library does, from the model file alone.

    Where no piece of the model joins a character to a following word space or
    to a line break, merges never cross there: the normalised text is cut at
    those places, and each distinct part is encoded by the library once (kept in
    a bounded table). Otherwise the whole text is one part."""

    KEEP = 200_000

    def __init__(self, model: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalizer = Normalizer(proto.normalizer_spec)
        self.library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.eos = self.library.eos_id()
        plain = pb.ModelProto()
        plain.CopyFrom(proto)
        spec = plain.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.parts = sp.SentencePieceProcessor(model_proto=plain.SerializeToString())
        normal = [p.piece for p in proto.pieces if p.type in (1, 4)]
        bpe = proto.trainer_spec.model_type == 2
        self.cuts = bpe and not any(p.type == 4 for p in proto.pieces) and not any(SPACE in p.lstrip(SPACE) for p in normal)
        lines = self.cuts and not any("\n" in p and len(p) > 1 for p in normal)
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        byte_piece, unknown = 6, 2
        self.known = np.array([1 if p.type == byte_piece else 0 if p.type == unknown else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.unk = self.library.unk_id()
        self.table: dict[str, tuple[tuple[int, ...], str]] = {}

    def _part(self, part: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.parts.encode(part))
        hit = (ids, " ".join(map(str, ids)))
        if len(self.table) < self.KEEP:
            self.table[part] = hit
        return hit

    def encode(self, text: str, spans: bool = True) -> tuple[list[int], str, np.ndarray | None]:
        """(ids with the end id, the same joined by spaces, byte offsets): piece i
        is source bytes [offsets[i], offsets[i + 1]); the end id is empty. Without spans
        the offsets are not worked out."""
        raw, src = self.normalizer(text)
        normal = raw.decode("utf-8")
        if self.cuts:
            get = self.table.get
            hits = [get(p) or self._part(p) for p in self.cut.findall(normal)]
            ids = list(chain.from_iterable([h[0] for h in hits]))
            joined = " ".join([h[1] for h in hits])
        else:
            ids = self.parts.encode(normal)
            joined = " ".join(map(str, ids))
        offsets = self._offsets(normal, ids, src) if spans else None
        ids.append(self.eos)
        return ids, f"{joined} {self.eos}" if joined else str(self.eos), offsets

    def _offsets(self, normal: str, ids: list[int], src: np.ndarray) -> np.ndarray:
        flat = np.array(ids, dtype=np.int64)
        widths = self.known[flat]
        if (flat == self.unk).any():
            widths = self._unknown_widths(normal)
        ends = np.concatenate(([0], np.cumsum(widths)))
        offsets = np.append(src[ends], src[-1])
        if len(offsets) > 1:
            offsets[0] = src[0]
        return offsets

    def _unknown_widths(self, normal: str) -> np.ndarray:
        """Unknown characters have no width in the vocabulary: ask for surfaces."""
        found = self.parts.encode(normal, out_type="immutable_proto").pieces
        return np.array([len(p.surface.encode()) for p in found], dtype=np.int64)


_OUTPUTS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "begins": pa.list_(pa.int64()),
    "ends": pa.list_(pa.int64()),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
    "covered_bytes": pa.int64(),
}


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded")) -> DataFrame:
    """One row per input row: the columns of keep (but those named like an output), then those
    of outputs: n_tokens (all
    ids), ids, begins and ends (source bytes of each piece), decoded, the digests
    ids_sha256 (decimal ids joined by a space) and decoded_sha256, and covered_bytes
    (source bytes under the pieces).

    Encoding is the library's with an end id only, without sampling; decoding is the
    library's decode(ids). A null text is empty: one end id, nothing decoded. The whole
    text is encoded, however long; a task holds one Arrow batch of texts and the tokens
    of 200 of them. Repeated rows give repeated rows; there is no shuffle."""
    from pyspark.sql.pandas.types import from_arrow_type

    keep = tuple(c for c in keep if c not in outputs)
    spans = any(c in outputs for c in ("begins", "ends", "covered_bytes"))
    schema = StructType([df.schema[c] for c in keep])
    for c in outputs:
        schema = schema.add(c, from_arrow_type(_OUTPUTS[c]))
    names = list(schema.names)
    decoding = any(c.startswith("decoded") for c in outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                out: dict[str, list] = {c: [] for c in outputs}
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    ids, joined, offsets = enc.encode(t or "", spans)
                    decoded = enc.library.decode(ids) if decoding else None
                    for c in outputs:
                        if c == "n_tokens":
                            x = len(ids)
                        elif c == "ids":
                            x = np.array(ids, dtype=np.int32)
                        elif c == "begins":
                            x = offsets[:-1]
                        elif c == "ends":
                            x = offsets[1:]
                        elif c == "decoded":
                            x = decoded
                        elif c == "ids_sha256":
                            x = hashlib.sha256(joined.encode()).hexdigest()
                        elif c == "decoded_sha256":
                            x = hashlib.sha256(decoded.encode()).hexdigest()
                        else:
                            x = int(offsets[-1] - offsets[0])
                        out[c].append(x)
                cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(out[c], _OUTPUTS[c]) for c in outputs)], names=names)

    return df.select(*keep, *([text] if text not in keep else [])).mapInArrow(work, schema)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"))
