"""Token ids of texts by a public tokenizer file, and small file helpers for tasks."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid

import numpy as np

#: Pieces remembered by a worker, about 150 bytes each; one more step of the table that holds them would double it.
MEMO = 345_000
# The character classes of the byte-level pattern, over the ranges of ``_PLAIN`` only.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PLAIN = re.compile("[\t-\r -~\x85\xa0-ɏЀ-ҁҊ-ӿ‐-‧]*")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level model: printable ones for themselves, the others from U+0100 on."""
    shown = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    hidden = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """Ids of pieces. When full it keeps what it has, and starts anew after as many misses as it has places."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.late = encode, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < MEMO:
            self[piece] = ids
        else:
            self.late += 1
            if self.late >= MEMO:
                self.clear()
                self.late = 0
        return ids


class Encoder:
    """Texts to ids in little-endian bytes of ``dtype``, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A byte-level model never merges across the pieces of its pattern, so the library's ids of a piece are remembered
    and joined. Texts with the name of an added token, which the library takes out first, texts with characters outside
    common ranges, and other kinds of models are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        )
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added)) if added else None
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.letters, self.split = byte_letters(), self.tok.model.tokenize
        self.form = "H" if self.dtype.itemsize == 2 else "I"
        self.memo = _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        """What the library does with a piece of its pattern: its bytes as letters go to the model."""
        ids = [t.id for t in self.split(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or _PLAIN.fullmatch(text) is None or (self.added and self.added.search(text)):
            return self._whole(text)
        return b"".join(map(self.memo.__getitem__, _PIECES.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that appears under its name when it is complete; a second attempt writes the same content again."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)
