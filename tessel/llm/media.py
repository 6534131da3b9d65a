"""Media columns: interleaved document sequences whose media references are resolved by digest.

``parse_interleaved`` turns a page into its texts and media references in page order, with captions beside their
references. References name payloads by digest (``sha256:...``), ``resolve`` joins them to a table of media. Payloads
are bytes held as 8-bit grey samples 64 wide (binary PGM), which is lossless; ``read_media`` reads the stored form back.
Payloads aren't shuffled: what the join moves is a row of measures per digest.

Cases: a null text is taken as empty, a null page as one without content; a reference that no payload has resolves to
nulls and keeps its place; equal payloads have equal digests and are measured once for the join; repeated rows give
repeated results; an empty table gives an empty result; columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.html import attributes, tokens
from tessel.llm.words import batches, slices
from tessel.session import release, settle, table

WIDTH = 64
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media", "embed": "media"}
#: Tags that part blocks of text.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "font", "i", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "noembed", "noframes"}
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_SEQUENCE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def interleave(page: str | None) -> list[dict]:
    """Texts and media references of a page, in order; a figure's caption, or else alt text, goes with its reference."""
    out: list[dict] = []
    text: list[str] = []
    figure: list[int] = []  # places of the open figure's references
    in_figure = in_caption = hidden = 0
    caption: list[str] = []

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append({"pos": len(out), "kind": "text", "text": words, "ref": None, "caption": None})

    for kind, name, rest in tokens(page or ""):
        if kind == "text":
            if not hidden:
                (caption if in_caption else text).append(rest)
            continue
        if name in HIDDEN:
            hidden = kind == "open"
        elif name in MEDIA and kind == "open":
            flush()
            of = attributes(rest)
            out.append({"pos": len(out), "kind": MEDIA[name], "text": None, "ref": of.get("src"), "caption": " ".join(of.get("alt", "").split()) or None})
            figure.append(len(out) - 1)
        elif name == "figcaption":
            if kind == "close" and in_caption:
                words = " ".join(html.unescape("".join(caption)).split())
                for i in figure:
                    out[i]["caption"] = words or out[i]["caption"]
            in_caption = kind == "open"
            caption.clear()
        elif name == "figure":
            flush()
            in_figure = kind == "open"
            figure.clear()
        elif name not in INLINE:
            (caption if in_caption else text).append(" ")
            if not in_caption:
                flush()
        if not in_figure and name in MEDIA:
            figure.clear()
    text += caption
    flush()
    return out


def parse_interleaved(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, html) to (keys, sequence)."""
    keys = keys or ("doc_id",)
    of = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows, "html"):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([interleave(t) for t in texts], _SEQUENCE)], [*keys, "sequence"])

    return pages.select(*keys, "html").mapInArrow(parse, f"{of}, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Each item of each sequence, media references joined by digest to ``media(digest, ...)``; one row per digest there.

    Texts keep their place and have nulls in media's columns.
    """
    items = sequences.select(*[c for c in sequences.columns if c != "sequence"], F.explode("sequence").alias("item"))
    items = items.select(*[c for c in items.columns if c != "item"], "item.*").withColumn("digest", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    return items.join(media, "digest", "left")


def pad(payload: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def encode_samples(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_samples(stored: bytes) -> bytes:
    kind, size, depth, samples = stored.split(b"\n", 3)
    w, h = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != w * h:
        raise ValueError("not an 8-bit grey PGM of its stated size")
    return samples


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy and the histogram over 8 bins of the samples, and the mean step between rows."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    rows = x.reshape(-1, WIDTH).mean(1)
    step = float(np.abs(np.diff(rows)).mean()) if len(rows) > 1 else 0.0
    entropy = max(0.0, -float((p * np.log2(p)).sum()))
    return f"{x.mean():.4f};{x.std():.4f};{entropy:.4f};{step:.4f};" + ",".join(map(str, counts.reshape(8, 32).sum(1)))


def page_of(text: str, digest: str) -> str:
    """A text as a page: its first line, the payload as a figure whose caption is the line's head, the other lines."""
    first, *rest = [html.escape(x, False) for x in text.split("\n")]
    figure = f'<figure><img src="sha256:{digest}" alt="text"><figcaption>{html.escape(text[:40].strip(), False)}</figcaption></figure>'
    return f"<p>{first}</p>{figure}" + "".join(f"<p>{x}</p>" for x in rest)


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html): each text as an interleaved page that refers to its payload."""
    of = docs.schema["doc_id"].dataType.simpleString()

    def pages(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            raw = [(t or "").encode() for t in texts]
            found = [page_of(t or "", hashlib.sha256(pad(r)).hexdigest()) for t, r in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(found, pa.string())], ["doc_id", "n_bytes", "html"])

    return docs.select("doc_id", "text").mapInArrow(pages, f"doc_id {of}, n_bytes long, html string")


def store_texts(docs: DataFrame) -> DataFrame:
    """(digest, media): each text as a payload in stored form."""

    def store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(rows):
            payloads = [pad((t or "").encode()) for t in texts]
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([encode_samples(p) for p in payloads], pa.binary())], ["digest", "media"])

    return docs.select("text").mapInArrow(store, "digest string, media binary")


MEASURED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Stored media read back and measured, a row per digest; the rows are made before they are shuffled."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            out = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                p = decode_samples(stored)
                out.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p)))
            names = [x.split()[0] for x in MEASURED.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in MEASURED.split(", ")]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    measured = media.select("digest", "media").mapInArrow(read, MEASURED)
    rest = [c for c in measured.columns if c != "digest"]
    return measured.groupBy("digest").agg(*[F.min(c).alias(c) for c in rest])


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all ``documents`` as interleaved pages; their references resolved and the payloads read back."""
    docs = table(spark, sf_dir, "documents")
    stored = settle(store_texts(docs), "media")
    measured = settle(read_media(stored), "media-measures")
    release(stored)
    found = resolve(parse_interleaved(text_pages(docs), "doc_id", "n_bytes"), measured).filter("kind = 'image'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
