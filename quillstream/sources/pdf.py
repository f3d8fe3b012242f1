"""Text of PDF files: the text operators of their pages, as Markdown or plain.

Understands uncompressed and Flate streams, literal and hexadecimal strings, arrays with kerning, and moves of the text
position. Strings are Windows-1252, or UTF-16 with a byte order mark. Fonts with an encoding of their own and scanned images
need a library; any function from bytes to text can take the place of these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from statistics import median

_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s()<>\[\]/%]*|[-+]?\d*\.?\d+|<<|>>|[A-Za-z'\"*][A-Za-z0-9'\"*]*|.", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}
#: A gap in an array of strings that is a space, in thousandths of the font size; a line step that begins a paragraph and sizes of headings, in those of the text.
SPACE, PARAGRAPH, HEADINGS = 200, 1.6, ((1.6, "# "), (1.25, "## "))


def _decode(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return _decode(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
    plain = lambda m: _NAMED[m[1]] if m[1] in _NAMED else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else m[1]
    return _decode(_ESCAPE.sub(plain, token[1:-1]))


def _contents(content: bytes) -> Iterator[bytes]:
    """The streams that show text, in the order of the file."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    found = False
    for m in _STREAM.finditer(content):
        found = True
        body = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", body):
            yield body
    if not found and re.search(rb"\bBT\b", content):
        yield content


def _lines(stream: bytes) -> Iterator[tuple[str, float, float]]:
    """(text, font size, step from the line before) of each line of a stream."""
    text, size, lead, y, last, held, array = "", 1.0, 0.0, 0.0, None, [], None
    started, scale, shown = False, 1.0, 1.0

    def line():
        nonlocal text, last, started, shown
        step = abs(last - y) if last is not None else 0.0
        out = (text, shown, step)
        text, last, started = "", y, False
        return out

    for token in _TOKEN.findall(stream):
        c = token[:1]
        if c.isspace() or c == b"%":
            continue
        if c == b"(" or c == b"<" and token != b"<<":
            (held if array is None else array).append(_string(token))
        elif c == b"[":
            array = []
        elif c == b"]":
            held.append(array or [])
            array = None
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            (held if array is None else array).append(float(token))
        elif c == b"/":
            held.append(token)
        else:
            op = token.decode("latin-1")
            number = lambda i: held[i] if len(held) >= -i and isinstance(held[i], float) else 0.0
            if op == "BT":
                y, scale = 0.0, 1.0
            elif op == "Tf":
                size = number(-1) or size
            elif op == "TL":
                lead = number(-1)
            elif op in ("Td", "TD", "T*", "Tm", "'", '"', "ET"):
                if started and (op in ("T*", "'", '"', "ET") or op == "Tm" and number(-1) != y or op in ("Td", "TD") and number(-1)):
                    yield line()
                if op == "Tm":
                    y, scale = number(-1), abs(number(-3)) or 1.0
                elif op in ("Td", "TD"):
                    y += number(-1)
                    lead = -number(-1) if op == "TD" else lead
                elif op != "ET":
                    y -= lead
            if op in ("Tj", "'", '"') and held and isinstance(held[-1], str):
                text, started, shown = text + held[-1], True, size * scale
            elif op == "TJ" and held and isinstance(held[-1], list):
                text += "".join(x if isinstance(x, str) else " " if x < -SPACE else "" for x in held[-1])
                started, shown = True, size * scale
            held = []
    if started:
        yield line()


def plain_pdf_text(content: bytes) -> str:
    """The text of a PDF, its lines and pages joined by line feeds."""
    return "\n".join(text for stream in _contents(content) for text, _, _ in _lines(stream))


def pdf_markdown(content: bytes) -> str:
    """The text of a PDF as Markdown: larger lines are headings, and a wider step between lines begins a paragraph."""
    rows = [(text.strip(), size, step) for stream in _contents(content) for text, size, step in _lines(stream) if text.strip()]
    if not rows:
        return ""
    body = median(size for _, size, _ in rows)
    steps = sorted(s for _, _, s in rows if s)
    usual = steps[len(steps) // 4] if steps else 0.0
    out: list[str] = []
    last = ""
    for text, size, step in rows:
        mark = next((m for least, m in HEADINGS if size >= least * body), "")
        if mark:
            out.append(mark + text)
        elif out and not last and (not usual or step <= PARAGRAPH * usual):
            out[-1] += ("\n" if out[-1].endswith("-") else " ") + text
        else:
            out.append(text)
        last = mark
    return "\n\n".join(out) + "\n"
