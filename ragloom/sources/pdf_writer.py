"""Pages of text lines and ruled tables as PDF bytes, for exports and for round trips through the reader."""

from __future__ import annotations

import zlib

#: Left edge, top line, distance of lines, size of text, width and height of a cell.
LEFT, TOP, LEADING, SIZE, CELL, ROW = 50, 780, 14, 10, 220, 20


def _content(page: dict, codes: dict[int, str]) -> str:
    """The content stream; `codes` has the hexadecimal code of each character's code point."""
    out, y = [], TOP
    if table := page.get("table"):
        wide, tall = max(map(len, table)) * CELL, len(table) * ROW
        out += [f"{LEFT} {y - k * ROW} m {LEFT + wide} {y - k * ROW} l S" for k in range(len(table) + 1)]
        out += [f"{LEFT + k * CELL} {y} m {LEFT + k * CELL} {y - tall} l S" for k in range(max(map(len, table)) + 1)]
        for r, row in enumerate(table):
            out += [f"BT /F1 {SIZE} Tf {LEFT + c * CELL + 4} {y - (r + 1) * ROW + 6} Td <{v.translate(codes)}> Tj ET" for c, v in enumerate(row) if v]
        y -= tall + 2 * LEADING
    if page.get("lines"):
        out.append(f"BT /F1 {SIZE} Tf {LEADING} TL {LEFT} {y} Td " + " T* ".join(f"<{t.translate(codes)}> Tj" for t in page["lines"]) + " ET")
    return "\n".join(out)


def written(pages: list[dict], packed: bool = False) -> bytes:
    """A file of pages, each with `lines` and a `table` (rows of cells) or either; packed: streams deflated, objects in an object stream."""
    chars = sorted(set().union(*(t for p in pages for t in [*p.get("lines", []), *(v or "" for row in p.get("table") or [] for v in row)])))
    codes = {ord(c): f"{k + 1:04X}" for k, c in enumerate(chars)}
    if len(codes) > 65_000:
        raise ValueError("too many distinct characters")
    pairs = [f"<{codes[ord(c)]}> <{c.encode('utf-16-be').hex().upper()}>" for c in chars]
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "\n".join(f"{len(p)} beginbfchar\n" + "\n".join(p) + "\nendbfchar" for p in (pairs[i : i + 100] for i in range(0, len(pairs), 100)))

    def stream(data: str) -> bytes:
        raw = zlib.compress(data.encode()) if packed else data.encode()
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if packed else b"", raw)

    kids = " ".join(f"{6 + 2 * k} 0 R" for k in range(len(pages)))
    plain = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 842] /Resources << /Font << /F1 3 0 R >> >> >>",
        3: "<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        4: "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>",
    } | {6 + 2 * k: f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * k} 0 R >>" for k in range(len(pages))}
    streams = {5: stream(cmap)} | {7 + 2 * k: stream(_content(p, codes)) for k, p in enumerate(pages)}
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    for n, body in streams.items():
        put(n, body)
    size = 6 + 2 * len(pages)
    if not packed:
        for n, text in plain.items():
            put(n, text.encode())
        at = len(out)
        table = "".join(f"{places[n]:010d} 00000 n \n" for n in range(1, size))
        out.extend(f"xref\n0 {size}\n0000000000 65535 f \n{table}trailer\n<< /Size {size} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())
        return bytes(out)
    head, body = [], ""
    for n, text in plain.items():
        head.append(f"{n} {len(body)}")
        body += text + "\n"
    first = " ".join(head) + "\n"
    raw = zlib.compress((first + body).encode())
    put(size, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(plain), len(first), len(raw), raw))
    at, where = len(out), {n: k for k, n in enumerate(plain)}
    entry = lambda n: bytes([0]) + bytes(6) if n == 0 else bytes([2]) + size.to_bytes(4, "big") + where[n].to_bytes(2, "big") if n in where else bytes([1]) + (at if n == size + 1 else places[n]).to_bytes(4, "big") + bytes(2)
    rows = b"".join(map(entry, range(size + 2)))
    # rows as differences from the one above
    wide, above, up = 7, bytes(7), b""
    for a in range(0, len(rows), wide):
        up += b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[a : a + wide], above, strict=True))
        above = rows[a : a + wide]
    raw = zlib.compress(up)
    out.extend(b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (size + 1, size + 2, len(raw), raw, at))
    return bytes(out)
