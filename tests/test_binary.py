"""Readers of PDF, Word 97 and images, on files made here."""

import struct
import zlib

import pytest

from tessera.sources import binary, readers


def pdf(objects, root=1, info=None, packed=()):
    """A file of objects {number: bytes or (dict bytes, stream)}; those in packed stand in an object stream."""
    out = [b"%PDF-1.5\n"]
    if packed:
        bodies, heads, at = [], [], 0
        for n in packed:
            heads.append(b"%d %d" % (n, at))
            bodies.append(objects[n])
            at += len(objects[n]) + 1
        head = b" ".join(heads) + b" "
        objects = {n: x for n, x in objects.items() if n not in packed} | {99: (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(packed), len(head)), zlib.compress(head + b" ".join(bodies)))}
    for n, x in objects.items():
        body = x if isinstance(x, bytes) else b"<< %s /Length %d >>\nstream\n%s\nendstream" % (x[0], len(x[1]), x[1])
        out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    out.append(b"trailer << /Root %d 0 R %s >>\nstartxref\n0\n%%%%EOF" % (root, b"/Info %d 0 R" % info if info else b""))
    return b"".join(out)


def sample(packed=()):
    show = rb"BT /F1 12 Tf 72 700 Td (Hello \(wide\) w\366rld\041) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* <4142> Tj ET"
    other = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 1 0 0 1 72 680 Tm <0003> Tj ET"
    cmap = b"begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    return pdf(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R >>",
            2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
            3: b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] >>",
            4: b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>",
            5: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
            6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
            7: (b"/Filter /FlateDecode", zlib.compress(show)),
            8: (b"", other),
            9: (b"/Filter [/FlateDecode]", zlib.compress(cmap)),
            10: b"<< /Title (A \\(short\\) title) /Author <FEFF00DC0041> /Subject () >>",
        },
        info=10,
        packed=packed,
    )


def word(text: str, wide: bool) -> bytes:
    """A compound file with a Word stream whose text is in two pieces."""
    body = bytearray(2048)
    struct.pack_into("<H", body, 0, 0xA5EC)
    struct.pack_into("<H", body, 10, 0x200)
    half, at, pcd, cps = len(text) // 2, 1024, b"", [0]
    for part, two in ((text[:half], False), (text[half:], wide)):
        raw = part.encode("utf-16-le" if two else "cp1252")
        body[at : at + len(raw)] = raw
        pcd += struct.pack("<HIH", 0, at if two else (at * 2) | 0x40000000, 0)
        cps.append(cps[-1] + len(part))
        at += len(raw) + len(raw) % 2
    plc = struct.pack("<3I", *cps) + pcd
    clx = b"\x01" + struct.pack("<H", 2) + b"xx" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", body, 0x1A2, 0, len(clx))
    table = clx.ljust(4096, b"\0")
    body = bytes(body).ljust(4096, b"\0")
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", *(0xFFFFFFFF,) * 3) + bytes(36) + struct.pack("<III", start, size, 0)
    folder = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, 2, 4096) + entry("1Table", 2, 10, 4096)).ljust(512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [3, 4, 5, 6, 7, 8, 9, 0xFFFFFFFE] + [11, 12, 13, 14, 15, 16, 17, 0xFFFFFFFE]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<II", 0, 1) + struct.pack("<III", 1, 0, 4096) + struct.pack("<IIII", 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *(0xFFFFFFFF,) * 108)
    return head + struct.pack("<128I", *fat, *(0xFFFFFFFF,) * (128 - len(fat))) + folder + body + table


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 31, 17, 8, 6, 0, 0, 0) + b"crc!" + struct.pack(">I4s", 12, b"tEXt") + b"Title\0a page" + b"crc!"
JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x10" + bytes(14) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 40, 60, 3) + bytes(9)


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 4, 5, 6, 10)])
def test_pdf(packed):
    text, meta = binary.pdf_document(sample(packed))
    assert text == "Hello (wide) wörld!\nSecond line\nAB\nЖa\nb"
    assert meta == {"title": "A (short) title", "author": "ÜA", "subject": "", "pages": "2"}


def test_pdf_with_a_broken_page_and_broken_files():
    data = sample().replace(b"/Filter /FlateDecode /Length", b"/Filter /Unknown /Length", 1)
    assert binary.pdf_document(data) == ("Жa\nb", {"title": "A (short) title", "author": "ÜA", "subject": "", "pages": "2", "unread_pages": "1"})
    for bad in (b"", b"plain text", b"%PDF-1.4\n", sample().replace(b"/Root", b"/Encrypt << >> /Root"), sample()[:200].replace(b"/Page", b"/P")):
        with pytest.raises(ValueError):
            binary.pdf_document(bad)


def test_word():
    text = "First line of text\rsecond \x13 HYPERLINK x \x14shown\x15 end\x07cell \x01x — done"
    want = "First line of text\nsecond shown end\tcell x — done"
    assert binary.doc_document(word(text, True)) == (want, {"characters": str(len(text))})
    assert binary.doc_document(word(text, False))[0] == want
    with pytest.raises(ValueError):
        binary.doc_document(b"\xd0\xcf\x11\xe0 not")


def test_files_of_all_kinds(spark, tmp_path):
    kinds = {"a.pdf": sample(), "b.doc": word("plain words of a document", False), "c.png": PNG, "d.jpg": JPEG, "e.jpeg": b"\xff\xd8nothing", "f.pdf": b"not one", "g.py": b"import os\nclass A:\n    pass\ndef f():\n    pass\nfrom x import y\n", "h.png": b"x"}
    for name, data in kinds.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.document_files(spark, str(tmp_path)).collect()}
    assert set(got) == set(kinds) and {n for n, r in got.items() if r.error} == {"e.jpeg", "f.pdf", "h.png"}
    assert all(got[n].text is None for n in ("e.jpeg", "f.pdf", "h.png"))
    assert got["a.pdf"].metadata["pages"] == "2" and got["b.doc"].text == "plain words of a document"
    assert got["c.png"].text == "[Image: c.png]" and got["c.png"].metadata == {"type": "image", "format": "PNG", "size": "31x17", "mode": "RGBA", "title": "a page"}
    assert got["d.jpg"].metadata["size"] == "60x40" and got["d.jpg"].metadata["mode"] == "RGB"
    assert got["g.py"].metadata == {"type": "code", "lines": "6", "imports": "import os\nfrom x import y", "functions": "def f():", "classes": "class A:"}
