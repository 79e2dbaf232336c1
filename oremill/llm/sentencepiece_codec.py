"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation (``Normalizer``): at each position the longest prefix in the model's compiled character map
(a double-array trie and a pool of replacements) is replaced; invalid prefixes copy one character; white
space is escaped; each normalised character remembers the byte of the source where it began. A model whose
map is empty (identity) keeps every character, and the alignment is the running sum of UTF-8 lengths. Every text goes through it.

Segmentation: the model, without a normaliser of its own, segments the normalised text. That is cut where no piece of the vocabulary
can cross (before a space mark that follows another character, and around a newline), and each distinct part is segmented once and kept in
a bounded memo; where pieces do cross, the whole text is one part. Every piece, byte fallback and unknown ones too, is projected
to the source's bytes through the alignment: it ends where the character after it began.

Defined results: null and empty texts give the end id only; decoding it gives an empty text; repeated rows
give repeated results; other columns are ignored; an empty table gives an empty result. Models that mark spaces after words are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: The mark that stands for a space, and what an unknown piece decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Characters that are segmented together, about.
GROUP = 1 << 20


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, varint()
        else:
            n = varint() if wire == 2 else 8 if wire == 1 else 4
            yield field, blob[at : at + n]
            at += n


class Normalizer:
    """The normaliser of a model file: fixed field numbers are those of the public model format."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        charmap = spec.get(2, b"")
        self.units, self.pool = (), b""
        if charmap:
            (n,) = struct.unpack_from("<I", charmap)
            self.units, self.pool = struct.unpack_from(f"<{n // 4}I", charmap, 4), charmap[4 + n :]

    @property
    def identity(self) -> bool:
        """Is every character kept, but for marks as spaces?"""
        return not self.units and not self.squeeze and self.escape

    def longest(self, source: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest mapped prefix of source[at:] and that prefix's length; one character as it is where none is mapped."""
        units, found, used, node = self.units, None, 0, 0
        if units:
            node = self._child(units[0])
            for k in range(at, len(source)):
                node ^= source[k]
                unit = units[node]
                if unit & (1 << 31 | 255) != source[k]:
                    break
                node ^= self._child(unit)
                if unit >> 8 & 1:
                    found, used = units[node] & (1 << 31) - 1, k - at + 1
        if found is not None:
            return self.pool[found : self.pool.index(b"\0", found)], used
        n = 1 + sum(source[at] >= x for x in (0xC0, 0xE0, 0xF0))
        return source[at : at + n], n

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the source byte where it begins."""
        if self.identity:
            return self._kept(text)
        source, out, align, at = text.encode(), [], [], 0
        if self.squeeze:
            while at < len(source) and (hit := self.longest(source, at))[0].strip(b" ") == b"":
                at += hit[1]
        if at == len(source):
            return "", np.array([at], np.int64)
        if self.dummy:
            out.append(" ")
            align.append(at)
        blank = self.squeeze
        while at < len(source):
            new, n = self.longest(source, at)
            for c in new.decode():
                if not (self.squeeze and blank and c == " "):
                    out.append(c)
                    align.append(at)
                blank = c == " "
            at += n
        while self.squeeze and out and (out[-1] == " " or self.escape and out[-1] == SPACE):  # a mark in the source ends as a space does
            at = align.pop()
            out.pop()
        s = "".join(out)
        return (s.replace(" ", SPACE) if self.escape else s), np.array([*align, at], np.int64)

    def _kept(self, text: str) -> tuple[str, np.ndarray]:
        """The same for an empty map: every longest prefix is one character that stays, so the alignment is a running sum of sizes."""
        if not text:
            return "", np.zeros(1, np.int64)
        s = text.replace(" ", SPACE)
        if text.isascii():
            align = np.arange(len(text) + 1)
        else:
            c = np.frombuffer(text.encode("utf-32-le"), "<u4")
            align = np.zeros(len(c) + 1, np.int64)
            np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000), out=align[1:])
        return (SPACE + s, np.r_[0, align]) if self.dummy else (s, align)


def segmenter(model: bytes) -> bytes:
    """The model with its normaliser (field 3) replaced by one that changes nothing: it segments text that is normalised already."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(k: int, v: int | bytes) -> bytes:
        if isinstance(v, int):
            return varint(k << 3) + varint(v)
        return varint(k << 3 | 2) + varint(len(v)) + v

    plain = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(field(k, v) for k, v in _fields(model) if k not in (3, 5)) + field(3, plain)


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        spec = dict(_fields(next((v for k, v in _fields(model) if k == 2), b"")))
        if spec.get(24, 0):
            raise ValueError("models that mark spaces after words are not supported")
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=segmenter(model))
        self.normalizer = Normalizer(model)
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.byte = {i: int(self.pieces[i][3:5], 16) for i in range(len(self.pieces)) if self.sp.is_byte(i)}
        self.hidden = {i for i in range(len(self.pieces)) if self.sp.is_control(i)}
        self.end, self.unknown = self.sp.eos_id(), self.sp.unk_id()
        plain = [p for i, p in enumerate(self.pieces) if i not in self.byte and i not in self.hidden and i != self.unknown]
        #: normalised text is cut where no piece can cross: at spaces, and at newlines if they are pieces or bytes (unknown characters side by
        #: side are one piece); a model whose pieces cross spaces gets whole texts
        newline = bool(self.byte) and not any("\n" in p for p in plain)
        spaces = SPACE in plain and not any(SPACE in p.lstrip(SPACE) for p in plain)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if newline else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if spaces else None
        self.special = {*self.byte, *self.hidden, self.unknown}
        self.part = base.Memo(None, 300_000)  # of normalised parts; see _part

    def parts(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.cut else [normal] if normal else []

    def known(self, texts: list[list[str]]) -> list[list[tuple[str, int, bytes, str]]]:
        """What each part of each text gives; those not in the memo are segmented by one call."""
        every = set().union(*texts)
        made = {p: g for p in every if (g := self.part.get(p) or self.part.old.get(p))}
        new = [p for p in every if p not in made]
        made.update((p, self._part(p, ids)) for p, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True))
        for p, g in made.items():
            if p not in self.part:
                self.part.put(p, g)
        return [list(map(made.__getitem__, parts)) for parts in texts]

    def _part(self, part: str, ids: list[int]) -> tuple[str, int, bytes, str]:
        """The ids as text, how many, steps, and the decoded part.

        steps: for each id, how many normalised characters it ends after the one before (low 24 bits), and, where it is a byte inside
        a character, which byte of it (high 8 bits); little-endian uint32."""
        if self.special.isdisjoint(ids):
            pieces = [self.pieces[i] for i in ids]
            steps, text = list(map(len, pieces)), "".join(pieces).replace(SPACE, " ")
        else:
            sizes = [len(p.surface) for p in self.sp.encode(part, return_type="proto").pieces] if self.unknown in ids else [len(self.pieces[i]) for i in ids]
            steps, at, inner, text = [], 0, 0, self.decode_pieces(ids)
            for i, n in zip(ids, sizes, strict=True):
                if i in self.byte:
                    inner += 1
                    n = inner == len(part[at].encode())
                    steps.append(1 if n else inner << 24)
                    inner = 0 if n else inner
                else:
                    steps.append(n)
                at += n
        return " ".join(map(str, ids)), len(ids), struct.pack(f"<{len(steps)}I", *steps), text

    def decode_pieces(self, ids: list[int]) -> str:
        """Ids to text, with marks as spaces and runs of byte pieces as UTF-8."""
        out = b"".join(bytes([self.byte[i]]) if i in self.byte else b"" if i in self.hidden else UNKNOWN.encode() if i == self.unknown else self.pieces[i].encode() for i in ids)
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """As the library's decode."""
        return self.trimmed(self.decode_pieces(ids), ids)

    def trimmed(self, text: str, ids: Iterable[int]) -> str:
        """Where the model adds or squeezes spaces, the mark that begins the first piece goes; if it squeezes them, those of pieces that are nothing else too."""
        n = 0
        if self.normalizer.dummy or self.normalizer.squeeze:
            for i in ids:
                if i in self.hidden:
                    continue
                if not self.pieces[i].startswith(SPACE):
                    break
                n += 1
                if not self.normalizer.squeeze or len(self.pieces[i]) > 1:
                    break
        return text[n:]

    def projected(self, align: np.ndarray, got: list[tuple[str, int, bytes, str]]) -> np.ndarray:
        """The source byte where each id ends, by the alignment of normalised characters."""
        steps = np.frombuffer(b"".join([x[2] for x in got]), "<u4")
        inner = steps >> 24
        at = np.cumsum(steps & 0xFFFFFF, dtype=np.int64)
        ends = align[at]
        if inner.any():
            ends = ends + np.minimum(inner, align[np.minimum(at + 1, len(align) - 1)] - ends)
        return ends

    def prepared(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[str, int, bytes, str]]]]:
        """Each text's alignment and what its parts give, in groups of about GROUP characters."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
                size += len(texts[to])
                to += 1
            normal = [self.normalizer(x) for x in texts[at:to]]
            yield from zip([a for _, a in normal], self.known([self.parts(x) for x, _ in normal]), strict=True)
            at = to

    def encode(self, text: str) -> list[int]:
        return [*self.spans([text])[0][0], self.end]

    def spans(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Of each text the ids without the end id, and the source byte where each ends (it begins where the one before ends)."""
        return [([int(i) for x in got for i in x[0].split()], self.projected(align, got)) for align, got in self.prepared(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """Of each text n_tokens, ids_sha256, decoded_sha256 and the CRC-32 of the spans' ends (little-endian uint32)."""
        out = []
        for align, got in self.prepared(texts):
            ids, decoded = "".join([x[0] + " " for x in got]), "".join([x[3] for x in got])
            decoded = self.trimmed(decoded, (int(i) for x in got for i in x[0].split()))
            out.append((1 + sum([x[1] for x in got]), _sha(f"{ids}{self.end}"), _sha(decoded), zlib.crc32(self.projected(align, got).astype("<u4").tobytes())))
        return out


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


_MADE: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    if (k := hash(model)) not in _MADE:
        _MADE.clear()
        _MADE[k] = Codec(model)
    return _MADE[k]


def _frame(docs: DataFrame, path: str, id_col: str, col: str, columns: str, rows) -> DataFrame:
    with open(path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            if b.num_rows:
                got = rows(c, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x)) for x in zip(*got, strict=True))], names)
        c.part.reset()  # the worker lives on for other operators

    return base.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(col).alias("text")), run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (with the end id) and ends: the source byte where each id but the end id ends. No shuffle."""
    return _frame(docs, path, id_col, text_col, "ids array<long>, ends array<long>", lambda c, texts: [([*ids, c.end], ends.tolist()) for ids, ends in c.spans([x or "" for x in texts])])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each list of ids; a null list gives an empty text."""
    return _frame(encoded, path, id_col, ids_col, "text string", lambda c, lists: [(c.decode(x or []),) for x in lists])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of every whole text, encoded, projected and decoded again. No shuffle."""
    return _frame(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", lambda c, texts: c.digests([x or "" for x in texts]))
