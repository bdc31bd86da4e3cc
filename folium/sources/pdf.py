"""Texts of PDF pages: page trees, plain and Flate streams, text operators, simple fonts and ToUnicode maps.

page_texts() reads what a file says itself, object by object, so broken cross-reference tables do no harm. Encrypted
files, and files without a page, are errors. Scanned pages have no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT, STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\b"), re.compile(rb"\bstream\r?\n")
LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R\b)")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"%[^\r\n]*|\((?:[^()\\]|\\.)*|<<|>>|<([0-9A-Fa-f\s]*)>|/[^\s()<>\[\]{}/%]*|[\[\]{}]|[^\s()<>\[\]{}/%]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r\n": b"", b"\n": b"", b"\r": b""}
#: Kerning, in thousandths of the font's size, from which a gap inside a shown array is a blank.
GAP = -200


def unescaped(s: bytes) -> bytes:
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPED.get(m[1], m[1]), s)


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """("string", bytes) and ("word", bytes) of a content stream; strings may hold balanced parentheses."""
    at = 0
    while m := TOKEN.search(data, at):
        at, t = m.end(), m[0]
        if t[:1] == b"(":
            depth, parts = 1, [t[1:]]
            while depth and at < len(data):
                c = data[at : at + 1]
                depth += {b"(": 1, b")": -1}.get(c, 0)
                more = re.compile(rb"(?:[^()\\]|\\.)*", re.S).match(data, at + 1)
                if depth:
                    parts.append(c + more[0])
                    at = more.end()
                else:
                    at += 1
            yield "string", unescaped(b"".join(parts))
        elif t[:1] == b"<" and m[1] is not None:
            digits = re.sub(rb"\s", b"", m[1])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] != b"%":
            yield "word", t


class Pdf:
    """The objects of a file, by number: dictionaries as bytes, streams undone on demand."""

    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no PDF file")
        if re.search(rb"trailer\s*<<[^>]*/Encrypt\b", content):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, bytes] = {}
        at = 0
        while m := OBJECT.search(content, at):
            stop = content.find(b"endobj", m.end())
            stop = len(content) if stop < 0 else stop
            data = STREAM.search(content, m.end(), stop)
            if data:  # which may hold anything: it ends where its length says, if it does
                length = LENGTH.search(content, m.end(), data.start())
                end = data.end() + int(length[1]) if length else stop
                if not content[end : end + 12].lstrip().startswith(b"endstream"):
                    end = content.find(b"endstream", data.end())
                stop = content.find(b"endobj", end)
                stop = len(content) if stop < 0 else stop
            self.objects[int(m[1])] = content[m.end() : stop]
            at = stop
        for n in list(self.objects):
            if re.search(rb"/Type\s*/ObjStm\b", self.objects[n]):
                self._unpack(n)

    def _unpack(self, n: int) -> None:
        """The objects inside an object stream."""
        head, data = self.objects[n], self.stream(n)
        first = int(self.entry(head, b"First"))
        places = list(map(int, data[:first].split()))
        for k, (number, at) in enumerate(zip(places[::2], places[1::2], strict=False)):
            stop = first + places[2 * k + 3] if 2 * k + 3 < len(places) else len(data)
            self.objects.setdefault(number, data[first + at : stop])

    def entry(self, head: bytes, name: bytes) -> bytes:
        """The value of a dictionary's entry as it stands there; empty if it has none."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*(\d+\s+\d+\s+R\b|\[.*?\]|<<.*?>>|/[^\s()<>\[\]{}/%]*|[-+.\d]+)", head, re.S)
        return m[1] if m else b""

    def resolved(self, value: bytes) -> bytes:
        m = REFERENCE.fullmatch(value.strip())
        return self.objects.get(int(m[1]), b"") if m else value

    def stream(self, n: int) -> bytes:
        body = self.objects.get(n, b"")
        m = STREAM.search(body)
        if not m:
            return b""
        data, head = body[m.end() :], body[: m.start()]
        length = LENGTH.search(head)
        fits = length and data[int(length[1]) :][:12].lstrip().startswith(b"endstream")
        data = data[: int(length[1])] if fits else data[: data.rfind(b"endstream")].rstrip(b"\r\n") if b"endstream" in data else data
        for kind in re.findall(rb"/([A-Za-z0-9]+)", self.resolved(self.entry(head, b"Filter"))):
            if kind == b"FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif kind == b"ASCIIHexDecode":
                digits = re.sub(rb"\s", b"", data.split(b">", 1)[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"the filter {kind.decode()} isn't known")
        return data

    def pages(self) -> list[bytes]:
        """The dictionaries of all pages, in the order of the page tree."""
        roots = [n for n, o in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", o)]
        top = REFERENCE.match(self.entry(self.objects[roots[-1]], b"Pages")) if roots else None
        todo, out, seen = [int(top[1])] if top else [], [], set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            o = self.objects.get(n, b"")
            if re.search(rb"/Type\s*/Page(?![A-Za-z])", o):
                out.append(o)
            todo += reversed([int(x) for x in REFERENCE.findall(self.resolved(self.entry(o, b"Kids")))])
        return out

    def maps(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """The ToUnicode maps of a page's fonts, by the fonts' names."""
        resources = self.resolved(self.entry(page, b"Resources"))
        holder = page if b"/Font" in page else resources
        fonts = re.search(rb"/Font\s*(\d+\s+\d+\s+R\b|<<.*?>>)", holder, re.S)
        out = {}
        for name, number in re.findall(rb"/([^\s()<>\[\]{}/%]+)\s+(\d+)\s+\d+\s+R", self.resolved(fonts[1]) if fonts else b""):
            m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.objects.get(int(number), b""))
            if m:
                out[name] = unicode_map(self.stream(int(m[1])))
        return out


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Two-byte codes and what they stand for."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", part):
            out |= {i: chr(int(to, 16) + i - int(a, 16)) for i in range(int(a, 16), int(b, 16) + 1)}
    return out


def shown_text(data: bytes, maps: dict[bytes, dict[int, str]]) -> str:
    """What a content stream shows: a line for each move to another one."""
    lines, now, stack, font, in_array = [], [], [], None, False

    def text(s: bytes) -> str:
        if font in maps:
            return "".join(maps[font].get(c, "") for c in (s[i] << 8 | s[i + 1] for i in range(0, len(s) - 1, 2)))
        return s[2:].decode("utf-16-be", "replace") if s[:2] == b"\xfe\xff" else s.decode("cp1252", "replace") if not any(0x80 <= c < 0xA0 for c in s) else s.decode("latin-1")

    def next_line() -> None:
        lines.append("".join(now))
        now.clear()

    begun = moved = False
    for kind, t in tokens(data):
        if kind == "string":
            stack.append(t)
        elif t in (b"[", b"]"):
            in_array = t == b"["
            if in_array:
                stack.clear()
        elif t == b"Tf":
            font = stack[-2][1:].encode("latin-1") if len(stack) > 1 and isinstance(stack[-2], str) else font
            stack.clear()
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"') or (moved and begun):
                next_line()
            moved = False
            for x in stack:
                if isinstance(x, float):
                    now.append(" " if x <= GAP and t == b"TJ" else "")
                elif isinstance(x, bytes):
                    now.append(text(x))
            begun = True
            stack.clear()
        elif t == b"T*":
            if begun:
                next_line()
            begun = True
            stack.clear()
        elif (t in (b"Td", b"TD") and len(stack) > 1 and stack[-1] != 0.0) or t in (b"Tm", b"BT"):
            moved = True
            stack.clear()
        elif re.fullmatch(rb"[-+]?[\d.]+", t):
            stack.append(float(t))
        elif t[:1] == b"/":
            stack.append(t.decode("latin-1"))  # names are str, strings bytes
        elif not in_array:
            stack.clear()
    return "\n".join([*lines, "".join(now)]) if begun else ""


def page_texts(content: bytes) -> list[str]:
    """The text of each page of a PDF file."""
    pdf = Pdf(content)
    pages = pdf.pages()
    if not pages:
        raise ValueError("the file has no pages")
    out = []
    for page in pages:
        parts = [int(x) for x in REFERENCE.findall(pdf.entry(page, b"Contents"))]
        body = b"\n".join(pdf.stream(n) or b"".join(pdf.stream(int(x)) for x in REFERENCE.findall(pdf.objects.get(n, b""))) for n in parts)
        out.append(shown_text(body, pdf.maps(page)))
    return out


def pdf_of(texts: list[str]) -> str:
    """A PDF file, in ASCII, with a page for each text of Latin-1 characters; every other stream is compressed."""
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    for k, text in enumerate(texts):
        quoted = [re.sub(r"[()\\]", r"\\\g<0>", x).encode("latin-1") for x in text.split("\n")]
        data = b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b" T*\n".join(b"(" + re.sub(rb"[\x00-\x1f\x7f-\xff]", lambda m: b"\\%03o" % m[0][0], x) + b") Tj" for x in quoted) + b"\nET"
        kind = "" if k % 2 else "/Filter [ /ASCIIHexDecode /FlateDecode ] "
        body = data.decode() if k % 2 else zlib.compress(data).hex() + ">"
        objects[4 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>"
        objects[5 + 2 * k] = f"<< {kind}/Length {len(body)} >>\nstream\n{body}\nendstream"
    objects[2] = f"<< /Type /Pages /Count {len(texts)} /Kids [ {' '.join(f'{4 + 2 * k} 0 R' for k in range(len(texts)))} ] >>"
    return "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{o}\nendobj\n" for n, o in sorted(objects.items())) + "trailer << /Root 1 0 R >>\n%%EOF"
