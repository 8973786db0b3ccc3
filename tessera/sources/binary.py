"""Text and metadata of PDF, Word 97 and image files, of which a task reads one at a time. What is broken raises ValueError."""

from __future__ import annotations

import re
import struct
import zlib

# ---- PDF --------------------------------------------------------------------------------------

_GAP = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*")
_TOKEN = re.compile(rb"<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[^\x00\t\n\f\r ()<>\[\]{}/%]+|[{}]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, or an operator of a content stream if it has no slash."""


class Ref(tuple):
    """A reference to an object: its number."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string whose opening bracket is before at."""
    out, depth = bytearray(), 1
    while depth:
        c = data[at : at + 1]
        if not c:
            raise ValueError("a PDF string without an end")
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            at += 2 if data[at : at + 2] == b"\r\n" else 1
            out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
    return bytes(out), at


def values(data: bytes, at: int = 0, one: bool = False):
    """The values of a piece of PDF, one after the other: numbers, names, bytes, lists, dicts, references; with one, only the first and the place after it."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    while True:
        at = _GAP.match(data, at).end()
        m = _TOKEN.match(data, at)
        if m is None:
            if at < len(data) and not one:
                at += 1
                continue
            break
        t, at = m[0], m.end()
        if t in (b"<<", b"["):
            kinds.append(t)
            stack.append([])
        elif t in (b">>", b"]"):
            if not kinds:
                continue
            got, kind = stack.pop(), kinds.pop()
            stack[-1].append(dict(zip(map(str, got[::2]), got[1::2])) if kind == b"<<" else got)
        elif t == b"(":
            s, at = _string(data, at)
            stack[-1].append(s)
        elif t[:1] == b"<":
            h = re.sub(rb"\s", b"", t[1:-1])
            stack[-1].append(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()))
        elif t[:1] == b"/":
            stack[-1].append(Name("/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")))
        elif t == b"R" and len(stack[-1]) > 1 and all(isinstance(x, int) for x in stack[-1][-2:]):
            stack[-1][-2:] = [Ref((stack[-1][-2],))]
        else:
            try:
                stack[-1].append(float(t) if b"." in t else int(t))
            except ValueError:
                stack[-1].append(Name(t.decode("latin-1")))
        if one and not kinds and stack[0]:
            return stack[0][0], at
    if one:
        return (stack[0][0] if stack[0] else None), at
    return stack[0]


class Pdf:
    """The objects of a file, found by their headers, so that a broken table of them does no harm; streams are unpacked when asked for."""

    def __init__(self, data: bytes):
        if not data[:1024].lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        self.at: dict[int, tuple] = {}
        for m in re.finditer(rb"(?<![0-9])([0-9]+)[\x00\t\n\f\r ]+[0-9]+[\x00\t\n\f\r ]+obj\b", data):
            self.at[int(m[1])] = data, m.end()  # of several the last, as in an updated file
        self.root = {}
        for m in re.finditer(rb"trailer", data):
            got, _ = values(data, m.end(), True)
            self.root |= got if isinstance(got, dict) else {}
        for n in list(self.at):
            d = self.get(Ref((n,)))
            if isinstance(d, dict) and d.get("/Type") == "/ObjStm":
                inner = self.stream(n)
                first = int(self.get(d["/First"]))
                heads = values(inner[:first])
                for k, off in zip(heads[::2], heads[1::2]):
                    self.at.setdefault(int(k), (inner, first + int(off)))
            elif isinstance(d, dict) and d.get("/Type") == "/XRef":
                self.root = {k: v for k, v in d.items() if k in ("/Root", "/Info", "/Encrypt")} | self.root
        if "/Encrypt" in self.root:
            raise ValueError("an encrypted PDF file")

    def get(self, x):
        """x, or the object that it refers to."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            data, at = self.at.get(x[0], (b"null", 0))
            x, _ = values(data, at, True)
        return None

    def stream(self, n: int) -> bytes:
        data, at = self.at[n]
        d, end = values(data, at, True)
        m = re.compile(rb"\s*stream\r?\n").match(data, end)
        if m is None:
            return b""
        size = self.get(d.get("/Length"))
        raw = data[m.end() : m.end() + size] if isinstance(size, int) and data[m.end() + size : m.end() + size + 20].lstrip().startswith(b"endstream") else data[m.end() : data.find(b"endstream", m.end())]
        filters = self.get(d.get("/Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "/FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
            elif f == "/ASCIIHexDecode":
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode())
            else:
                raise ValueError(f"a stream with {f}")
        parms = self.get(d.get("/DecodeParms")) or {}
        return _unpredicted(raw, int(self.get(parms.get("/Columns", 1)))) if isinstance(parms, dict) and parms.get("/Predictor", 1) >= 10 else raw

    def pages(self):
        """The pages in order, each with what it takes from its parents."""
        top = self.get((self.get(self.root.get("/Root")) or {}).get("/Pages"))
        todo, seen = [(top, {})] if top else [(self.get(Ref((n,))), {}) for n in sorted(self.at) if isinstance(self.get(Ref((n,))), dict) and self.get(Ref((n,))).get("/Type") == "/Page"], 0
        while todo and seen < 1_000_000:
            page, above = todo.pop(0)
            seen += 1
            if isinstance(page, dict):
                own = above | {k: page[k] for k in ("/Resources",) if k in page}
                if "/Kids" in page:
                    todo[:0] = [(self.get(k), own) for k in self.get(page["/Kids"]) or []]
                else:
                    yield own | page


def _unpredicted(raw: bytes, columns: int) -> bytes:
    out, before = bytearray(), bytearray(columns)
    for i in range(0, len(raw) - columns, columns + 1):
        kind, row = raw[i], bytearray(raw[i + 1 : i + 1 + columns])
        for j in range(len(row)):
            a, b, c = row[j - 1] if j else 0, before[j], before[j - 1] if j else 0
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda x: abs(a + b - c - x)))[kind] if kind < 5 else 0
            row[j] = row[j] + guess & 255
        out += row
        before = row
    return bytes(out)


def _unicode(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


def _font(pdf: Pdf, font: dict) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and what codes mean where the font says it."""
    wide = 2 if font.get("/Subtype") == "/Type0" else 1
    table: dict[int, str] = {}
    if isinstance(font.get("/ToUnicode"), Ref):
        got, run = values(pdf.stream(font["/ToUnicode"][0])), []
        for x in got:
            if x == "endbfchar":
                table |= {int.from_bytes(a, "big"): _unicode(b) for a, b in zip(run[::2], run[1::2])}
            elif x == "endbfrange":
                for a, b, c in zip(run[::3], run[1::3], run[2::3]):
                    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(lo, min(hi, lo + 65535) + 1):
                        table[k] = _unicode(c[k - lo]) if isinstance(c, list) else chr(int.from_bytes(c, "big") + k - lo) if len(c) <= 2 else _unicode(c[:-1] + bytes([c[-1] + k - lo & 255]))
            if isinstance(x, (bytes, list)):
                run.append(x)
            elif isinstance(x, Name):
                if x == "endcodespacerange" and run and isinstance(run[0], bytes):
                    wide = len(run[0])
                run = []
    return wide, table


def _shown(raw: bytes, font: tuple[int, dict[int, str]]) -> str:
    wide, table = font
    codes = [int.from_bytes(raw[i : i + wide], "big") for i in range(0, len(raw), wide)]
    return "".join(table.get(c) or (bytes([c]).decode("cp1252", "ignore") if wide == 1 else "") for c in codes)


def page_text(pdf: Pdf, page: dict) -> str:
    """The text of a page as its operators show it: a line where the place moves down, a space where a gap is wide."""
    own = pdf.get(page.get("/Contents"))
    refs = own if isinstance(own, list) else [page["/Contents"]] if "/Contents" in page else []
    data = b"\n".join(pdf.stream(r[0]) for r in refs if isinstance(r, Ref))
    found = pdf.get((pdf.get(page.get("/Resources")) or {}).get("/Font")) or {}
    fonts, font, out, args, line = {k: _font(pdf, pdf.get(v) or {}) for k, v in found.items()}, (1, {}), [], [], None
    for x in values(data):
        if not isinstance(x, Name) or x.startswith("/"):
            args.append(x)
            continue
        if x == "Tf" and len(args) > 1:
            font = fonts.get(str(args[-2]), (1, {}))
        elif x in ("Td", "TD") and len(args) > 1:
            out.append("\n" if args[-1] else " ")
        elif x == "Tm" and len(args) > 5:
            out.append("\n" if line is not None and args[-1] != line else " ")
            line = args[-1]
        elif x in ("T*", "'", '"', "ET"):
            out.append("\n")
        if x in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            out.append(_shown(args[-1], font))
        elif x == "TJ" and args and isinstance(args[-1], list):
            out += [_shown(y, font) if isinstance(y, bytes) else " " if y < -200 else "" for y in args[-1]]
        args = []
    lines = (re.sub(r"[ \t]+", " ", s).strip() for s in "".join(out).split("\n"))
    return "\n".join(s for s in lines if s)


def pdf_document(data: bytes) -> tuple[str, dict]:
    """The pages' texts, a line each; title, author and subject. A page that can't be read is left out and counted, and a file without pages is an error."""
    pdf, out, pages, bad = Pdf(data), [], 0, 0
    for page in pdf.pages():
        pages += 1
        try:
            out.append(page_text(pdf, page))
        except (ValueError, KeyError, TypeError, zlib.error, RecursionError):
            bad += 1
    if not pages:
        raise ValueError("a PDF file without pages")
    info = pdf.get(pdf.root.get("/Info")) or {}
    said = {k: pdf.get(info.get(f"/{k.title()}")) for k in ("title", "author", "subject")}
    text = lambda b: b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("latin-1")
    return "\n".join(x for x in out if x), {k: text(v) for k, v in said.items() if isinstance(v, bytes)} | {"pages": str(pages)} | ({"unread_pages": str(bad)} if bad else {})


# ---- Word 97 ----------------------------------------------------------------------------------


def compound(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_mini, _, first_more, more = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda n: data[size * (n + 1) : size * (n + 2)]
    heads = list(struct.unpack_from("<109I", data, 76))
    for _ in range(more):
        got = struct.unpack(f"<{size // 4}I", sector(first_more))
        heads += got[:-1]
        first_more = got[-1]
    fat = [x for h in heads if h < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(h))]

    def chain(n: int, table, read) -> bytes:
        out, left = [], len(table) + 1
        while n < 0xFFFFFFFA and left:
            out.append(read(n))
            n, left = table[n] if n < len(table) else 0xFFFFFFFE, left - 1
        if not left:
            raise ValueError("a compound file whose chain has no end")
        return b"".join(out)

    entries, root = chain(first_dir, fat, sector), None
    mini = chain(first_mini, fat, sector)
    mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
    out = {}
    for i in range(0, len(entries) - 127, 128):
        n, kind, start, length = struct.unpack_from("<H", entries, i + 64)[0], entries[i + 66], *struct.unpack_from("<II", entries, i + 116)
        name = entries[i : i + max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = chain(start, fat, sector)
        elif kind == 2:
            within = lambda k: root[small * k : small * (k + 1)]
            out[name] = (chain(start, mini_fat, within) if length < cutoff and root is not None else chain(start, fat, sector))[:length]
    return out


def doc_document(data: bytes) -> tuple[str, dict]:
    """The text of a Word 97 file by its table of pieces; field codes and control characters are left out."""
    parts = compound(data)
    word = parts.get("WordDocument", b"")
    if len(word) < 0x1AA or struct.unpack_from("<H", word)[0] != 0xA5EC:
        raise ValueError("not a Word 97 file")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise ValueError("an encrypted Word file")
    table = parts["1Table" if flags & 0x200 else "0Table"]
    at, size = struct.unpack_from("<II", word, 0x1A2)
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:  # formats of pieces
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("a Word file without pieces")
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    out = []
    for k in range(n):
        place = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        count, begin = ends[k + 1] - ends[k], place & 0x3FFFFFFF
        out.append(word[begin // 2 : begin // 2 + count].decode("cp1252", "replace") if place & 0x40000000 else word[begin : begin + 2 * count].decode("utf-16-le", "replace"))
    text = re.sub("\x13[^\x13\x14\x15]*\x14|[\x13-\x15]", "", "".join(out))
    text = text.replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n\n").replace("\x07", "\t")
    return re.sub(r"[\x00-\x08\x0e-\x1f]", "", text).strip(), {"characters": str(ends[-1] if ends else 0)}


# ---- images -----------------------------------------------------------------------------------

# Colour types of PNG, and components of JPEG.
_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
_JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def png_document(data: bytes) -> tuple[None, dict]:
    """No text; size, mode, and the file's text entries."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, _, mode = struct.unpack_from(">IIBB", data, 16)
    meta, at = {"type": "image", "format": "PNG", "size": f"{width}x{height}", "mode": _PNG_MODES.get(mode, str(mode))}, 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"tEXt" and b"\0" in (body := data[at + 8 : at + 8 + n]):
            key, value = body.split(b"\0", 1)
            meta[key.decode("latin-1").lower()] = value.decode("latin-1")
        at += 12 + n
    return None, meta


def jpeg_document(data: bytes) -> tuple[None, dict]:
    """No text; size and mode."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG file with a broken segment")
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD9:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            return None, {"type": "image", "format": "JPEG", "size": f"{width}x{height}", "mode": _JPEG_MODES.get(parts, str(parts))}
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("a JPEG file without a frame")
