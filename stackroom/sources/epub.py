"""EPUB files: package document, word and illustration counts, cover. Standard library only."""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
from fnmatch import fnmatchcase
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

MIN_MEGAPIXELS = 0.25


class _Text(HTMLParser):
    """The text of a page without scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF or JPEG; (0, 0) if unknown."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                i += 1
                continue
            mark = data[i + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            if mark == 0xFF or 0xD0 <= mark <= 0xD9:
                i += 1 if mark == 0xFF else 2
                continue
            i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return 0, 0


class Epub:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(BytesIO(data))
        names = self.zip.namelist()
        self.opf = self._package(names)
        self.base = posixpath.dirname(self.opf)
        self.root = ElementTree.fromstring(self.zip.read(self.opf))
        self.items = [{k: e.get(k) or "" for k in ("id", "href", "media-type", "properties")} for e in self._all("item")]

    def _package(self, names: list[str]) -> str:
        """The package document the container file names; without a usable one the first in the archive."""
        if "META-INF/container.xml" in names:
            try:
                root = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
            except ElementTree.ParseError:
                root = None
            paths = [e.get("full-path") or "" for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "rootfile"] if root is not None else []
            if found := [p for p in paths if p in names]:
                return found[0]
        return next(n for n in names if n.lower().endswith(".opf"))

    def _all(self, name: str):
        return [e for e in self.root.iter() if e.tag.rsplit("}", 1)[-1] == name]

    def _texts(self, name: str) -> list[str]:
        return [(e.text or "").strip() for e in self._all(name)]

    def _resolve(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.base, href.lstrip("/"))) if href else ""

    def _persons(self, name: str) -> list[dict]:
        refined = {e.get("refines", "").lstrip("#"): (e.text or "").strip() for e in self._all("meta") if e.get("property") == "role"}
        out = []
        for e in self._all(name):
            role = next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "role"), "") or refined.get(e.get("id") or "-", "")
            out.append({"full_name": (e.text or "").strip(), "role": role})
        return out

    def information(self) -> dict:
        """The fields of a package record."""
        metas = {e.get("name"): e.get("content") for e in self._all("meta") if e.get("name")}
        groups = {e.get("id"): (e.text or "").strip() for e in self._all("meta") if e.get("property") == "belongs-to-collection"}
        series = metas.get("calibre:series") or next(iter(groups.values()), None)
        place = next(((e.text or "").strip() for e in self._all("meta") if e.get("property") == "group-position"), None)
        event = lambda e: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "event"), "")
        return {
            "title": self._texts("title"), "creator": self._persons("creator"), "contributor": self._persons("contributor"),
            "description": self._texts("description"), "language": self._texts("language"), "subject": self._texts("subject"),
            "date": [{"stamp": (e.text or "").strip(), "event": event(e)} for e in self._all("date")],
            "series": series, "series_index": metas.get("calibre:series_index") or place,
        }

    def words(self) -> int:
        """Words of the content pages, without the navigation page."""
        n = 0
        for name in self.zip.namelist():
            if not fnmatchcase(name, "O*PS/*.*htm*") or posixpath.basename(name) == "nav.xhtml":
                continue
            page = _Text()
            page.feed(self.zip.read(name).decode("utf-8", "replace"))
            n += len(" ".join(page.parts).split())
        return n

    def cover_name(self) -> str:
        """The cover's entry: by manifest property, then by meta tag, then by name; a page leads to its first image."""
        hrefs = [i["href"] for i in self.items if "cover-image" in i["properties"].lower()]
        if not hrefs:
            for e in self._all("meta"):
                if (e.get("name") or "").lower() == "cover" and (want := e.get("content")):
                    hrefs += [i["href"] for i in self.items if i["id"] == want] or ([want] if "." in want or "/" in want else [])
        if not hrefs:
            hrefs = [i["href"] for i in self.items if i["media-type"].startswith("image/") and "cover" in (i["id"] + i["href"]).lower()]
        if not hrefs:
            return ""
        name = self._resolve(hrefs[0])
        if posixpath.splitext(name)[1].lower() in (".xhtml", ".html", ".htm", ".svg") and name in self.zip.namelist():
            m = re.search(r"""(?:src|xlink:href|href)\s*=\s*["']([^"']+\.(?:jpe?g|png|gif|webp))["']""", self.zip.read(name).decode("utf-8", "replace"), re.I)
            if m:
                return posixpath.normpath(posixpath.join(posixpath.dirname(name), m[1]))
        return name

    def cover(self) -> bytes | None:
        """The cover's bytes as stored; scaling needs an imaging library, which isn't there."""
        name = self.cover_name()
        return self.zip.read(name) if name in self.zip.namelist() else None

    def illustrations(self, least: float = MIN_MEGAPIXELS) -> int:
        """Distinct images of at least that many megapixels, without the cover."""
        cover, seen = self.cover_name(), set()
        for i in self.items:
            name = self._resolve(i["href"])
            if i["media-type"].startswith("image/") and name != cover and name not in seen and name in self.zip.namelist():
                w, h = image_size(self.zip.read(name))
                if w * h / 1e6 >= least:
                    seen.add(name)
        return len(seen)
