"""Compressed blocks of TIFF files: LZW and PackBits."""

from __future__ import annotations

from ..model import GridIOError

# Fixed values of the form: the code that empties the table, the one that ends a block, and the widest code.
CLEAR, END, WIDEST = 256, 257, 12


def lzw(raw: bytes) -> bytes:
    """A block of codes of 9 to 12 bits, high bits first; a width ends one code early, as the file form has it."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, out = list(first), 9, 0, 0, []
    before = b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == CLEAR:
            table, width, before = list(first), 9, b""
            continue
        if code == END:
            break
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise GridIOError("an LZW block has a code that its table lacks")
        if before:
            table.append(before + now[:1])
            if len(table) >= (1 << width) - 1 and width < WIDEST:
                width += 1
        out.append(now)
        before = now
    return b"".join(out)


def packbits(raw: bytes) -> bytes:
    """Runs of bytes: n in 0 to 127 precedes n + 1 bytes, n in 129 to 255 a byte that stands 257 - n times."""
    out, at = [], 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out.append(raw[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(raw[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)
