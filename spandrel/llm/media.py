"""Media columns: documents as interleaved sequences of texts and media references.

``parse_html`` turns a page into its ordered elements: runs of text and media
references, each with its position, and a reference with its digest and caption.
Payloads live once in a media store keyed by their SHA-256 digest; ``resolve``
joins references with the store by digest, so a digest that many documents share
costs one payload, and positions and captions stay with their references.

A payload is stored as a lossless PNG of 8-bit RGB samples, 64 pixels a row:
bytes are padded with spaces to a positive multiple of 192. Reading goes through
the stored bytes: chunks are checked, inflated and unfiltered.

Defined cases: a null text or page counts as an empty one (its payload is 192
spaces); references without a known digest keep null features; null ids are
kept; repeated rows stay repeated; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.arrow import map_rows
from spandrel.session import materialize

ROW_BYTES, PIXELS = 192, 64
SCHEME = "sha256:"
ELEMENTS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (ROW_BYTES - len(raw) if not raw else -len(raw) % ROW_BYTES)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes) -> bytes:
    """An RGB image of 64 pixels a row, rows unfiltered."""
    rows = len(payload) // ROW_BYTES
    if not rows or len(payload) % ROW_BYTES:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {ROW_BYTES}")
    lines = b"".join(b"\0" + payload[at : at + ROW_BYTES] for at in range(0, len(payload), ROW_BYTES))
    head = struct.pack(">IIBBBBB", PIXELS, rows, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def _unfilter(kind: int, line: bytearray, above: bytes) -> None:
    """Undo one PNG row filter in place; three bytes a pixel."""
    for i in range(len(line)):
        left = line[i - 3] if i >= 3 else 0
        if kind == 1:
            guess = left
        elif kind == 2:
            guess = above[i]
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            corner = above[i - 3] if i >= 3 else 0
            near = left + above[i] - corner
            guess = min((left, above[i], corner), key=lambda v: abs(near - v))
        line[i] = (line[i] + guess) & 255


def read_png(media: bytes) -> tuple[bytes, int, int]:
    """Samples, width and height of an 8-bit RGB image without interlacing; a damaged chunk raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, height, packed = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 2, 0):
                raise ValueError("not 8-bit RGB")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    lines, step = zlib.decompress(b"".join(packed)), 3 * width + 1
    out, above = [], bytes(3 * width)
    for row in range(height):
        line = lines[row * step + 1 : (row + 1) * step]
        if lines[row * step]:
            line = bytearray(line)
            _unfilter(lines[row * step], line, above)
            line = bytes(line)
        out.append(line)
        above = line
    return b"".join(out), width, height


class _Interleaver(HTMLParser):
    """Collects ordered texts and media references; scripts, styles and head are left out."""

    SILENT = frozenset(("script", "style", "head", "noscript", "template"))
    MEDIA = frozenset(("img", "video", "audio", "source"))
    BREAKS = frozenset(("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "article", "section", "td", "tr", "table", "ul", "ol", "nav", "footer", "blockquote", "pre"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.elements.append([len(self.elements), "text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in self.BREAKS and self.caption is None:
            self.flush()
        if tag in self.MEDIA:
            found = dict(attrs)
            self.flush()
            source = found.get("src") or ""
            self.elements.append([len(self.elements), "media", None, source[len(SCHEME) :] if source.startswith(SCHEME) else hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest(), found.get("alt")])
            self.figure.append(len(self.elements) - 1)
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for at in self.figure:
                self.elements[at][4] = said
        elif tag in self.BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = []

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_elements(page: str | None) -> list[tuple]:
    parser = _Interleaver()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [tuple(e) for e in parser.elements]


def parse_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, elements): each page's interleaved sequence."""

    def make():
        names = ("position", "kind", "text", "digest", "caption")
        return lambda row: iter([(row["i"], [dict(zip(names, e)) for e in parse_elements(row["h"])])])

    own = pages.select(F.col(id_col).cast("long").alias("i"), F.col(html_col).cast("string").alias("h"))
    return map_rows(own, make, f"{id_col} long, elements {ELEMENTS}", flush=256)


def references(sequences: DataFrame, id_col: str, *carried: str) -> DataFrame:
    """One row per media reference: id, carried columns, position, digest, caption."""
    media = F.filter("elements", lambda e: e.kind == "media")
    return sequences.select(id_col, *carried, F.explode(media).alias("e")).select(id_col, *carried, "e.position", "e.digest", "e.caption")


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): the payload of every row as PNG, written to the shared folder and read from there."""

    def make():
        def work(row):
            payload = padded(row["t"])
            yield hashlib.sha256(payload).hexdigest(), write_png(payload)

        return work

    return materialize(map_rows(docs.select(F.col(text_col).cast("string").alias("t")), make, "digest string, media binary", flush=256), "media")


def features_of(media: bytes) -> tuple:
    """Features from the stored bytes: sizes, digests, check sum, and the image's mean sample and range."""
    payload, width, height = read_png(media)
    samples = np.frombuffer(payload, dtype=np.uint8)
    feature = f"{width}x{height}x3;mean={samples.sum(dtype=np.int64) / len(samples):.4f};min={samples.min()};max={samples.max()}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(store: DataFrame) -> DataFrame:
    """One row of features a digest."""

    def make():
        def work(row):
            yield (row["digest"], *features_of(row["media"]))

        return work

    return map_rows(store, make, FEATURES).dropDuplicates(["digest"])


def resolve(refs: DataFrame, features: DataFrame) -> DataFrame:
    """References with the features of their payloads, by digest; unknown digests keep nulls."""
    return refs.join(features, "digest", "left")


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, html): each whole text as a page, a paragraph a line, with one figure after the first half of them.

    The figure refers to the text's payload by digest.
    """

    def make():
        def work(row):
            text = row["t"] or ""
            digest = hashlib.sha256(padded(text)).hexdigest()
            size = len(text.encode("utf-8", "surrogatepass"))
            lines = [f"<p>{html.escape(line)}</p>" for line in text.split("\n")]
            figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{size} bytes</figcaption></figure>'
            half = (len(lines) + 1) // 2
            yield row["i"], size, "".join(["<article>", *lines[:half], figure, *lines[half:], "</article>"])

        return work

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")), make, f"{id_col} long, n_bytes long, html string", flush=64)


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the features of each document's payload, resolved over its page's media reference.

    Also the number of elements of the page's sequence, the position and caption of the media among them, and the
    digest of its texts in order. Features are written before the join, so that a hot digest can be split.
    """
    sequences = parse_html(text_pages(docs), "doc_id")
    texts = F.transform(F.filter("elements", lambda e: e.kind == "text"), lambda e: e.text)
    whole = sequences.select("doc_id", "elements", F.size("elements").alias("n_elements"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("texts_sha256"))
    refs = references(whole, "doc_id", "n_elements", "texts_sha256")
    found = resolve(refs, materialize(media_features(store_texts(docs)), "features"))
    size = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_elements", "texts_sha256")
