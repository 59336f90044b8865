"""Whole-text encoding with a public tokenizers file, each distinct piece once."""

from __future__ import annotations

import functools
import re
import struct

#: Pieces that a worker remembers; rarer ones are encoded again. A bound on memory, not on results.
MOST_PIECES = 250_000
END_ID = 1
SAMPLE = "It's the Élève's über-große Straße, 42% of (x+y)=z; niño's 'tis we'll DON'T... á été 中文 İx ~til__und#er https://a.b/c?d=e ÿß×÷ K Å ẞ\n\tEnd."


class ChunkEncoder:
    """ids of a text in UTF-8, as little-endian unsigned 32-bit integers, as the file's own pipeline gives them.

    Texts of ASCII and Latin-1 letters, the most by far, are lower-cased and cut into the pieces that the file's
    pre-tokenizer makes, and the file's model encodes each distinct piece once a worker. In other texts each chunk
    between white space goes through the file's whole pipeline, which never joins across white space. Both ways are
    compared with the pipeline at the start; where a file differs, whole texts are encoded by it. So are texts that may
    hold one of the file's added tokens, which have ids of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode(), re.IGNORECASE).search if added else lambda text: None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
        plain = letters + "0123456789" + "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
        self.plain = re.compile(f"[{re.escape(plain)} \t\n\r\x0b\x0c]*")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\s{letters}0-9]+").findall
        self.table = {ord(c): "".join(p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(c)) for c in plain} if self.whole.pre_tokenizer else {}
        self.short = self.chunked = "".join(added).isascii()  # added tokens are found in any case, but in one form only
        wanted = [self._whole(s) for s in (SAMPLE, SAMPLE.encode("ascii", "ignore").decode())]
        for way in ("short", "chunked"):
            if [self.encode(s.encode()) for s in (SAMPLE, SAMPLE.encode("ascii", "ignore").decode())] == wanted:
                break
            setattr(self, way, False)
        self.pieces.clear()
        self.chunks.clear()

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        tokens = self.whole.model.tokenize(piece.translate(self.table))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(self.pieces) < MOST_PIECES:
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        low = chunk.decode("utf-8", "replace").lower()
        if self.short and self.plain.fullmatch(low):
            return b"".join([self.pieces.get(p) or self._piece(p) for p in self.split(low)])
        ids = self._whole(chunk.decode("utf-8", "replace"))
        if len(self.chunks) < MOST_PIECES // 4:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if self.added(text):
            return self._whole(text.decode("utf-8", "replace"))
        if self.short:
            low = text.decode("utf-8", "replace").lower()
            if self.plain.fullmatch(low):
                known, make = self.pieces.get, self._piece
                return b"".join([known(p) or make(p) for p in self.split(low)])
        if self.chunked:
            known, make = self.chunks.get, self._chunk
            return b"".join([known(c) or make(c) for c in text.split()])
        return self._whole(text.decode("utf-8", "replace"))

    def encode_document(self, text: bytes | None, end_id: int = END_ID) -> bytes:
        """ids of a whole text (null: empty) with the end id."""
        return self.encode(text or b"") + struct.pack("<I", end_id)


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and file."""
    return ChunkEncoder(path)
