"""PDF files: information dictionary, page count, language, images. A minimal reader on the standard library.

It reads objects in the open and in compressed object streams; encrypted files and exotic filters are errors, which the
library scan puts into quarantine.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        # in a trailer or a cross-reference stream, not in a page's text
        if re.search(rb"/Encrypt\s*(?:\d+\s+\d+\s+R\b|<<)", _STREAM.sub(b"", data)):
            raise ValueError("an encrypted PDF file")
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in _OBJECT.findall(data)}
        self.data = data
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        raw = m[1] if m else b""
        return zlib.decompressobj().decompress(raw) if b"/FlateDecode" in body else raw

    def _unpack(self, body: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", body)
        if not first:
            return
        try:
            text = self._stream(body)
        except zlib.error:
            return
        head = list(map(int, re.findall(rb"\d+", text[: int(first[1])])))
        starts = [*(o + int(first[1]) for o in head[1::2]), len(text)]
        for n, a, b in zip(head[::2], starts, starts[1:], strict=False):
            self.objects.setdefault(n, text[a:b])

    def _follow(self, key: bytes) -> bytes:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", self.data) or next(
            (x for b in self.objects.values() if (x := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", b))), None
        )
        return self.objects.get(int(m[1]), b"") if m else b""

    @staticmethod
    def _string(raw: bytes, key: bytes) -> str:
        m = re.search(rb"/" + key + rb"\s*(?:\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<([0-9A-Fa-f\s]*)>)", raw, re.S)
        if not m:
            return ""
        if m[1] is not None:
            data = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda e: _ESCAPES.get(e[1], bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else e[1] if e[1] in (b"(", b")", b"\\") else b""), m[1])
        else:
            digits = re.sub(rb"\s", b"", m[2])
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if data[:2] == b"\xfe\xff":
            return data[2:].decode("utf-16-be", "replace").strip()
        return data.decode("utf-8" if data[:3] == b"\xef\xbb\xbf" else "cp1252", "replace").lstrip("﻿").strip()

    def information(self) -> dict:
        info, root = self._follow(b"Info"), self._follow(b"Root")
        get = lambda k: self._string(info, k)
        return {
            "title": get(b"Title"), "author": get(b"Author"), "subject": get(b"Subject"), "created": get(b"CreationDate"),
            "modified": get(b"ModDate"), "language": get(b"Language") or self._string(root, b"Lang"),
        }

    def pages(self) -> int:
        return sum(bool(re.search(rb"/Type\s*/Page(?![a-zA-Z])", b)) for b in self.objects.values())

    def illustrations(self, least: float = 0.25) -> int:
        """Distinct image objects of at least that many megapixels."""
        n = 0
        for b in self.objects.values():
            if re.search(rb"/Subtype\s*/Image\b", b):
                w, h = (re.search(rb"/" + k + rb"\s+(\d+)", b) for k in (b"Width", b"Height"))
                n += bool(w and h and int(w[1]) * int(h[1]) / 1e6 >= least)
        return n

    def cover(self) -> bytes | None:
        """The first embedded JPEG."""
        for b in self.objects.values():
            if re.search(rb"/Subtype\s*/Image\b", b) and b"/DCTDecode" in b and (m := _STREAM.search(b)):
                return m[1]
        return None
