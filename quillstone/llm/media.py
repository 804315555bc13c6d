"""Operator 4, media columns: interleaved document sequences.

HTML is parsed to an ordered sequence of text and media references. References are digests; a join on them resolves what
is stored of each payload, so that a payload is kept and decoded apart from the documents that show it. Position and caption
stay with the reference through the join.

Payloads are stored as grey PNG images of 8-bit samples, ``WIDTH`` samples a line.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import documents, fresh_path, stored

WIDTH = 576
#: Digests of payloads that a task remembers so as not to store them again; beyond, a payload may be stored more than once.
REMEMBERED = 200_000
SEQUENCE = "page_id long, position int, n_items int, kind string, text string, digest string, caption string, before string, after string"
DECODED = "digest string, width int, height int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG of 8-bit samples; their number must be a positive multiple of width. Equal samples give equal bytes."""
    lines = np.zeros((len(samples) // width, width + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of to_png()'s image, by line; checks each chunk's checksum. ValueError for what isn't such an image."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey image of 8-bit samples")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, a histogram of 16 levels in thousandths, and 64 bits: which of 64 stretches are above the mean."""
    flat = samples.reshape(-1)
    levels = np.bincount(flat >> 4, minlength=16) * 1000 // flat.size
    edges = np.arange(64) * flat.size // 64
    sums = np.add.reduceat(flat.astype(np.uint32), edges)
    means = sums / np.diff(np.append(edges, flat.size))
    bits = "".join("1" if m > flat.mean() else "0" for m in means)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.3f};levels={'.'.join(map(str, levels))};stretches={int(bits, 2):016x}"


class _Sequence(HTMLParser):
    """Text between media and media references, in order. A figure's caption goes to its media; else the alt text does.

    A caption ends with its figure and with the page at the latest; if no media takes it, it is text.
    """

    HIDDEN = frozenset(("script", "style", "template", "noscript"))
    MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
    PARTING = frozenset(("p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.caption, self.figure = 0, None, None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": text})
        self.text = []

    def end_caption(self) -> None:
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        media = [item for item in self.items[self.figure :] if item["kind"] == "media"] if self.figure is not None else []
        for item in media:
            item["caption"] = said
        if not media:
            self.text += [" ", said, " "]

    def end(self) -> list[dict]:
        self.close()
        self.end_caption()
        self.flush()
        return self.items

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA and (ref := dict(attrs).get("src")):
            self.flush()
            digest = ref.removeprefix("urn:sha256:") if ref.startswith("urn:sha256:") else hashlib.sha256(ref.encode("utf-8", "replace")).hexdigest()
            self.items.append({"kind": "media", "digest": digest, "caption": dict(attrs).get("alt")})
        elif tag in self.PARTING:
            (self.text if self.caption is None else self.caption).append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.figure = None
        elif tag in self.PARTING:
            (self.text if self.caption is None else self.caption).append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    return parser.end()


def _placed(items: list[dict]) -> Iterator[dict]:
    """items with their positions, those of media with the text right before and after them."""
    for at, item in enumerate(items):
        row = item | {"position": at, "n_items": len(items)}
        if item["kind"] == "media":
            row |= {"before": items[at - 1].get("text") if at else None, "after": items[at + 1].get("text") if at + 1 < len(items) else None}
        yield row


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split()[0] for f in SEQUENCE.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 6)
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            pages = zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns), strict=True)
            rows = [{"page_id": i} | row for i, html in pages for row in _placed(parse(html))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(fields, types, strict=True)], names=fields)


def sequences(pages: DataFrame) -> DataFrame:
    """Rows of SEQUENCE for pages (page_id, html): each page's items by position from 0, of kind text or media.

    digest is the reference's own if it reads urn:sha256:..., else the sha256 of the reference; before and after are the texts
    beside a media item, null where there is none. A null or empty page, or one that holds neither, gives no rows; unclosed
    and unknown tags are read as a browser would. Other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_parsed, SEQUENCE)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        rows = []
        for digest, data in zip(batch.column(0), batch.column(1), strict=True):
            raw = data.as_buffer().to_pybytes() if data.is_valid else b""
            row = dict.fromkeys(schema.names) | {"digest": digest.as_py(), "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
            try:
                samples = from_png(raw)
            except (ValueError, zlib.error, struct.error):
                rows.append(row)
                continue
            payload = samples.tobytes()
            rows.append(row | {"width": samples.shape[1], "height": samples.shape[0], "n_bytes": len(payload.rstrip(b"\xff")), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "feature": feature(samples)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def described(media: DataFrame) -> DataFrame:
    """Rows of DECODED for stored media (digest, media), one for each digest: decoded, measured, the payload itself left behind.

    n_bytes is without the filling of bytes 255. Media that can't be decoded have nulls there. The rows are stored, so that in
    a join on digests those that many pages show can be split.
    """
    each = media.select("digest", "media").mapInArrow(_described, DECODED)
    return stored(each.groupBy("digest").agg(*[F.first(c).alias(c) for c in each.columns if c != "digest"]), "media-described")


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """items of sequences() with what described() gives for their digests, null for text and where nothing is stored.

    Text has no digest and doesn't move; a digest that many pages show is split by Spark's handling of skewed joins.
    """
    shown = items.where(F.col("digest").isNotNull()).join(media, "digest", "left")
    text = items.where(F.col("digest").isNull()).withColumns({c: F.lit(None).cast(t) for c, t in media.dtypes if c != "digest"})
    return shown.unionByName(text)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page with one figure for each document, and the image of its text. A task stores a payload that it has seen before as a reference alone."""
    seen: set[bytes] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            pages, digests, media = [], [], []
            for text in part.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                image = to_png(raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH)))
                digest = hashlib.sha256(image).digest()
                pages.append(f'<article><p>Text as an image</p><figure><img src="urn:sha256:{digest.hex()}"><figcaption>{len(raw)} bytes</figcaption></figure><p>End</p></article>')
                digests.append(digest.hex())
                media.append(None if digest in seen else image)
                if len(seen) < REMEMBERED:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], names=["page_id", "html", "digest", "media"])


def store_texts(docs: DataFrame, path: str) -> None:
    """docs (doc_id, text) as Parquet of page_id, html, digest, media: each text's bytes, filled up with bytes 255, as an image."""
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored, "page_id long, html string, digest string, media binary").write.option("compression", "zstd").parquet(path)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image, shown by a page, and resolved from the page's reference."""
    path = fresh_path(spark, "media")
    store_texts(documents(spark, sf_dir), path)
    kept = spark.read.schema("page_id long, html string, digest string, media binary").parquet(path)
    shown = sequences(kept.select("page_id", "html")).where(F.col("kind") == "media")
    found = shown.join(described(kept.where(F.col("media").isNotNull())), "digest", "left")
    measured = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return found.select(F.col("page_id").alias("doc_id"), *measured, "position", "n_items", "before", "after", "caption")
