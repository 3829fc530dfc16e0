"""Text layers of PDF files: text and block boxes of each page, one file at a time in an Arrow map.

Read are classic and compressed object streams, Flate streams, the page tree with inherited media boxes, and the text
operators of page contents (positions, lines, strings and arrays of strings) with fonts' ToUnicode maps; without a map
bytes are Windows Latin. Not read are encrypted files, form objects, and glyph names: such text is left out or garbled, which
``chunks.garbage`` finds. A file that is no PDF, or broken, gives one row with its error and no page;
empty files are left out by the scan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE = "path string, page int, text string, boxes array<array<double>>, error string"
KINDS = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.float64())), pa.string()]

TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\()|(?P<list>[\[\]])|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<ref>\d+\s+\d+\s+R\b)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)"
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, as opposed to an operator."""


class Ref(int):
    """A reference to an object by its number."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A string in round brackets from behind the first, and the place behind its last."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", raw[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                e = raw[at : at + 1]
                at += 1
                out += b"" if e in (b"\n", b"\r") else ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(raw: bytes) -> Iterator[object]:
    """Values and operators of a piece of a file: dicts and lists are nested, operators are bytes."""
    stack: list[list] = [[]]
    at = 0
    while m := TOKEN.search(raw, at):
        at, kind = m.end(), m.lastgroup
        value: object = None
        if kind == "open":
            value, at = _string(raw, at)
            value = bytearray(value)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            value = bytearray.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(m["name"].decode("latin-1"))
        elif kind == "ref":
            value = Ref(m["ref"].split()[0])
        elif kind == "num":
            value = float(m["num"])
        elif kind == "word":
            value = m["word"]
        elif m["dict"] == b"<<" or m["list"] == b"[":
            stack.append([])
            continue
        elif kind in ("dict", "list") and len(stack) > 1:
            own = stack.pop()
            value = dict(zip(own[::2], own[1::2], strict=False)) if kind == "dict" else own
        else:
            continue
        if len(stack) == 1:
            yield value
        else:
            stack[-1].append(value)


class Pdf:
    def __init__(self, raw: bytes):
        if b"%PDF" not in raw[:1024]:
            raise ValueError("no PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S):
            self._keep(int(m[1]), m[2])
        for n, d in list(self.objects.items()):
            if isinstance(d, dict) and d.get("Type") == "ObjStm" and n in self.streams:
                body, first = self.streams[n], int(d.get("First", 0))
                heads = [int(x) for x in body[:first].split()]
                for number, a, z in zip(heads[::2], heads[1::2], [*heads[3::2], len(body)], strict=False):
                    self.objects.setdefault(number, next(tokens(body[first + a : first + z]), None))
        if any(isinstance(x, dict) and "Encrypt" in x for x in map(self._trailer, re.findall(rb"trailer(.*?)startxref", raw, re.S))):
            raise ValueError("encrypted")

    @staticmethod
    def _trailer(raw: bytes) -> object:
        return next(tokens(raw), None)

    def _keep(self, number: int, body: bytes) -> None:
        head, _, rest = body.partition(b"stream")
        own = next(tokens(head), None)
        self.objects[number] = own
        if rest and isinstance(own, dict):
            data = re.sub(rb"^\r?\n", b"", rest)
            data = data[: data.rfind(b"endstream")]
            filters = own.get("Filter", [])
            for f in filters if isinstance(filters, list) else [filters]:
                if f != "FlateDecode":
                    return
                data = zlib.decompressobj().decompress(data)
            self.streams[number] = data

    def get(self, x: object) -> object:
        for _ in range(20):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(int(x))
        return x

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        roots = [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"]
        out, todo = [], [(self.get(r.get("Pages")), {}) for r in reversed(roots[-1:])]
        while todo:
            node, above = todo.pop()
            if not isinstance(node, dict) or len(out) > 100_000:
                continue
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Pages":
                todo += [(self.get(k), own) for k in reversed(self.get(node.get("Kids")) or [])]
            else:
                out.append(node | own)
        return out

    def content(self, page: dict) -> bytes:
        c = page.get("Contents")
        inner = self.get(c)
        refs = inner if isinstance(inner, list) else [c]
        return b"\n".join(self.streams.get(int(r), b"") for r in refs if isinstance(r, Ref))

    def fonts(self, page: dict) -> dict[str, dict[bytes, str] | None]:
        resources = self.get(page.get("Resources")) or {}
        found = self.get(resources.get("Font")) or {}
        out = {}
        for name, ref in found.items():
            to = (self.get(ref) or {}).get("ToUnicode")
            out[name] = _cmap(self.streams[int(to)]) if isinstance(to, Ref) and int(to) in self.streams else None
        return out


def _cmap(raw: bytes) -> dict[bytes, str]:
    """Codes to text of a ToUnicode map."""
    text = lambda b: bytes(b).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        own = list(tokens(body))
        out |= {bytes(a): text(b) for a, b in zip(own[::2], own[1::2], strict=False)}
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        own = list(tokens(body))
        for a, z, to in zip(own[::3], own[1::3], own[2::3], strict=False):
            lo, hi, n = int.from_bytes(a), int.from_bytes(z), len(a)
            for i in range(min(hi - lo, 65535) + 1):
                if isinstance(to, list):
                    out[(lo + i).to_bytes(n)] = text(to[i]) if i < len(to) else ""
                else:
                    out[(lo + i).to_bytes(n)] = text((int.from_bytes(to) + i).to_bytes(len(to)))
    return out


def _shown(raw: bytes, font: dict[bytes, str] | None) -> str:
    if not font:
        return raw.decode("cp1252", "replace")
    n = len(next(iter(font)))
    return "".join(font.get(raw[i : i + n], "") for i in range(0, len(raw), n))


def page_text(pdf: Pdf, page: dict) -> tuple[str, list[list[float]]]:
    """Text of a page, a line for each line shown and an empty one between blocks, and the blocks' boxes (x, y, width,
    height from the top left, in shares of the page, four decimals)."""
    box = [float(x) for x in (pdf.get(page.get("MediaBox")) or [0, 0, 612, 792])]
    width, height = max(box[2] - box[0], 1e-9), max(box[3] - box[1], 1e-9)
    fonts, font, size = pdf.fonts(page), None, 12.0
    x = y = left = 0.0
    lead, args, lines = 0.0, [], []

    def show(raw: bytes) -> None:
        t = _shown(bytes(raw), font)
        if lines and abs(lines[-1][1] - y) < 0.3 * size and x >= lines[-1][0]:
            lines[-1][3] += t
        else:
            lines.append([x, y, size, t])

    for t in tokens(pdf.content(page)):
        if not isinstance(t, bytes):
            args.append(t)
            continue
        n = [a for a in args if isinstance(a, float)]
        if t == b"BT":
            x = y = left = 0.0
        elif t == b"Tf" and n:
            font, size = fonts.get(next((a for a in args if isinstance(a, Name)), "")), abs(n[-1]) or 12.0
        elif t == b"TL" and n:
            lead = n[-1]
        elif t in (b"Td", b"TD") and len(n) >= 2:
            left, y = left + n[-2], y + n[-1]
            x, lead = left, -n[-1] if t == b"TD" else lead
        elif t == b"Tm" and len(n) >= 6:
            left = x = n[-2]
            y, size = n[-1], size if abs(n[-6]) <= 1 else abs(n[-6])
        if t in (b"T*", b"'", b'"'):
            x, y = left, y - (lead or size)
        if t in (b"Tj", b"'", b'"'):
            for a in args:
                if isinstance(a, bytearray):
                    show(a)
        elif t == b"TJ":
            for a in next((a for a in args if isinstance(a, list)), []):
                if isinstance(a, bytearray):
                    show(a)
                elif isinstance(a, float) and a < -200 and lines:
                    lines[-1][3] += " "
        args = []
    blocks: list[list] = []
    for line in lines:
        near = blocks and 0 <= blocks[-1][-1][1] - line[1] <= 1.8 * max(line[2], blocks[-1][-1][2])
        blocks[-1].append(line) if near else blocks.append([line])
    clamp = lambda v: round(max(0.0, min(1.0, v)), 4)
    boxes = []
    for b in blocks:
        x0, x1 = min(r[0] for r in b), max(r[0] + 0.5 * r[2] * len(r[3]) for r in b)
        top, low = max(r[1] + r[2] for r in b), min(r[1] for r in b)
        boxes.append([clamp((x0 - box[0]) / width), clamp((box[3] - top) / height), clamp((x1 - x0) / width), clamp((top - low) / height)])
    return "\n\n".join("\n".join(r[3] for r in b) for b in blocks), boxes


def read_pages(files: DataFrame) -> DataFrame:
    """path, page (from 1), text, boxes, error of files (path, content): a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                path, rows = batch.column(0)[i].as_py(), []
                try:
                    pdf = Pdf(batch.column(1)[i].as_py() or b"")
                    rows = [(path, n, *page_text(pdf, p), None) for n, p in enumerate(pdf.pages(), 1)]
                except (ValueError, zlib.error, TypeError, AttributeError, KeyError) as e:
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], names=["path", "page", "text", "boxes", "error"])

    return files.select("path", "content").mapInArrow(run, PAGE)
