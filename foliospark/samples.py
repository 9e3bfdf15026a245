"""Small publications bound in memory, for queries and tests."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field
from html import escape

#: A PNG of one pixel.
PIXEL = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000d49444154789c63600000000200015c0d0a2db40000000049454e44ae426082")
#: Fixed values of the format: namespaces, member names and the declared kind.
SPACES = {"container": "urn:oasis:names:tc:opendocument:xmlns:container", "package": "http://www.idpf.org/2007/opf", "facts": "http://purl.org/dc/elements/1.1/", "page": "http://www.w3.org/1999/xhtml", "ops": "http://www.idpf.org/2007/ops"}
KIND = b"application/epub+zip"
CONTAINER = "META-INF/container.xml"
#: Folder, media type and first letter of the ids of each sort of part.
SORTS = {"leaf": ("leaves", "application/xhtml+xml", "l"), "plate": ("plates", "image/png", "p"), "sheet": ("look", "text/css", "s"), "register": ("leaves", "application/xhtml+xml", "r")}


@dataclass
class Binder:
    """Collects parts and packs them as an archive below one folder, with its package file beside them."""

    title: str = "Tide Tables"
    language: str = "en"
    facts: list[tuple[str, str]] = field(default_factory=list)
    parts: list[tuple[str, str, bytes, str]] = field(default_factory=list)
    strays: dict[str, bytes] = field(default_factory=dict)

    def add(self, sort: str, name: str, content: bytes, label: str = "") -> Binder:
        self.parts.append((sort, name, content, label))
        return self

    def leaf(self, heading: str, inner: str) -> Binder:
        """A document; they are named leaf-a.xhtml, leaf-b.xhtml and so on."""
        name = f"leaf-{chr(97 + sum(p[0] == 'leaf' for p in self.parts))}.xhtml"
        page = f'<html xmlns="{SPACES["page"]}"><head><title>{heading}</title></head><body><h1>{heading}</h1>{inner}</body></html>'
        return self.add("leaf", name, page.encode(), heading)

    def plate(self, name: str, content: bytes = PIXEL) -> Binder:
        return self.add("plate", name, content)

    def look(self, css: str) -> Binder:
        return self.add("sheet", "plain.css", css.encode())

    def fact(self, name: str, value: str) -> Binder:
        self.facts.append((name, value))
        return self

    def stray(self, name: str, content: bytes) -> Binder:
        """A member that the package does not list."""
        self.strays[name] = content
        return self

    def register(self) -> Binder:
        """A table of contents, first in reading order."""
        rows = "".join(f'<li><a href="{name}">{escape(label)}</a></li>' for sort, name, _, label in self.parts if sort == "leaf")
        page = f'<html xmlns="{SPACES["page"]}" xmlns:epub="{SPACES["ops"]}"><body><nav epub:type="toc"><ol>{rows}</ol></nav></body></html>'
        self.parts.insert(0, ("register", "register.xhtml", page.encode(), ""))
        return self

    def package(self) -> bytes:
        listed, read = [], []
        for at, (sort, name, _, _) in enumerate(self.parts):
            folder, media, letter = SORTS[sort]
            extra = ' properties="nav"' if sort == "register" else ""
            listed.append(f'<item media-type="{media}" href="{folder}/{name}" id="{letter}{at}"{extra}/>')
            if letter in "lr":
                read.append(f'<itemref idref="{letter}{at}"/>')
        told = [("language", self.language), ("title", self.title), ("creator", "A. Keeper"), ("identifier", f"urn:example:{len(self.title)}"), *self.facts]
        facts = "".join(f"<d:{n}>{escape(v)}</d:{n}>" for n, v in told)
        return f'<package version="3.0" xmlns="{SPACES["package"]}"><metadata xmlns:d="{SPACES["facts"]}">{facts}</metadata><manifest>{"".join(listed)}</manifest><spine>{"".join(read)}</spine></package>'.encode()

    def pack(self, without: str | None = None, kind: bytes = KIND) -> bytes:
        """The archive's bytes; without names a member to leave out."""
        root = f'<container version="1.0" xmlns="{SPACES["container"]}"><rootfiles><rootfile media-type="application/oebps-package+xml" full-path="bound/all.opf"/></rootfiles></container>'
        members = [("mimetype", kind), (CONTAINER, root.encode()), ("bound/all.opf", self.package())]
        members += [(f"bound/{SORTS[sort][0]}/{name}", content) for sort, name, content, _ in self.parts]
        members += self.strays.items()
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for name, content in members:
                if name != without:
                    archive.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), content, zipfile.ZIP_DEFLATED)
        return buffer.getvalue()


def small() -> Binder:
    """One leaf, without a register."""
    return Binder().leaf("Ebb", "<p>The harbour is empty.</p>")


def sample_archives() -> list[tuple[str, bytes]]:
    linked = Binder("Le Phare", "fr").fact("publisher", "Sel & Fils").plate("p.png").look(".x { color: red }")
    linked.leaf("One", '<p id="a">See <a href="leaf-b.xhtml#b">two</a> <img src="../plates/p.png" srcset="../plates/p.png 2x"/></p>')
    linked.leaf("Two", '<p id="b">Back to <a href="leaf-a.xhtml">one</a></p>').register()
    return [("linked", linked.pack()), ("plain", small().pack()), ("torn", b"not an archive")]
