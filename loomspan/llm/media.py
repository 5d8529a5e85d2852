"""Media columns: signature sniffing with an Aho-Corasick automaton, format validation, type correction and carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import steps

#: Signatures, where they stand in the format, and the format.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"), (b"GIF87a", 0, "gif"), (b"GIF89a", 0, "gif"), (b"\xff\xd8\xff", 0, "jpeg"), (b"RIFF", 0, "riff"),
    (b"BM", 0, "bmp"), (b"%PDF-", 0, "pdf"), (b"\x1f\x8b\x08", 0, "gzip"), (b"PK\x03\x04", 0, "zip"), (b"ftyp", 4, "mp4"),
]
TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "pdf": "application/pdf", "gzip": "application/gzip", "zip": "application/zip", "mp4": "video/mp4", "wav": "audio/wav", "webp": "image/webp", "avi": "video/avi"}
RIFF = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}


_places: dict[bytes, tuple[bytes, int, int]] = {}


def next_place(b: bytes, mark: bytes, at: int) -> int:
    """Where ``mark`` stands next in a blob, -1 if nowhere. The last answer holds for all places up to it, so many calls cost one search."""
    blob, lo, hit = _places.get(mark, (None, 0, 0))
    if blob is not b or not lo <= at or (0 <= hit < at):
        hit = b.find(mark, at)
        _places[mark] = (b, at, hit)
    return hit


def u32(b: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", b, at)[0] if at + 4 <= len(b) else -1


def png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = u32(b, p, ">"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != u32(b, p + 8 + n, ">"):
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "png", p - at
    return None


#: Signatures of a kind in a blob from which on walks are told for all places at once.
MANY = 8
_tables: dict[str, tuple[bytes, Any]] = {}


def table_of(kind: str, b: bytes, mark: bytes, make: Callable[[bytes, int], Any]) -> Any:
    """``make`` of a blob with more than ``MANY`` marks, kept for the blob at hand; None for one with fewer."""
    blob, table = _tables.get(kind, (None, None))
    if blob is not b:
        table = make(b, b.find(mark)) if b.count(mark) > MANY else None
        _tables[kind] = (b, table)
    return table


def gif_next(b: bytes, p: int) -> int:
    """Where the data blocks of an extension or image at ``p`` begin; 0 if there is none."""
    if b[p] == 0x21:
        return p + 2
    return p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0) if b[p] == 0x2C and p + 11 <= len(b) else 0


def gif_table(b: bytes, first: int) -> tuple[array, array]:
    """For each place from ``first`` on, from the end backwards: where data blocks that begin there end, and where the file ends whose
    next part begins there (twice that, plus 1 if an image is on the way; 0 if none does)."""
    n = len(b)
    blocks, ends = array("q", bytes(8 * (n + 1 - first))), array("q", bytes(8 * (n + 1 - first)))
    for p in range(n - 1, first - 1, -1):
        q = p + b[p] + 1
        blocks[p - first] = p + 1 if not b[p] else blocks[q - first] if q < n else q + 1
        if b[p] == 0x3B:
            ends[p - first] = 2 * (p + 1)
        elif start := gif_next(b, p):
            q = blocks[start - first] if start < n else start + 1
            end = ends[q - first] if q < n else 0
            ends[p - first] = end and end | (b[p] == 0x2C)
    return blocks, ends


def gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    if table := table_of("gif", b, b"GIF8", gif_table):
        first = b.find(b"GIF8")
        end = table[1][p - first] if p < len(b) else 0
        return ("gif", (end >> 1) - at) if end & 1 else None

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return ("gif", p + 1 - at) if images else None
        start = gif_next(b, p)
        if not start:
            return None
        images += b[p] == 0x2C
        p = blocks(start)
    return None


def jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p, frames = at + 2, 0
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if kind in (0xD8, 0xD9) or n < 2:
            return None
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return ("jpeg", p + 2 - at) if frames else None
    return None


def riff(b: bytes, at: int) -> tuple[str, int] | None:
    n, kind = u32(b, at + 4), RIFF.get(bytes(b[at + 8 : at + 12]))
    end = at + 8 + n + (n & 1)
    if not kind or n < 4 or end > len(b):
        return None
    if kind == "wav":
        parts = dict(riff_chunks(b, at))
        if b"fmt " not in parts or b"data" not in parts or parts[b"fmt "][1] < 16:
            return None
    return kind, end - at


def riff_chunks(b: bytes, at: int) -> Iterator[tuple[bytes, tuple[int, int]]]:
    """Name, start and size of each chunk."""
    p, end = at + 12, at + 8 + u32(b, at + 4)
    while p + 8 <= end:
        n = u32(b, p + 4)
        if p + 8 + n > end:
            return
        yield bytes(b[p : p + 4]), (p + 8, n)
        p += 8 + n + (n & 1)


def bmp(b: bytes, at: int) -> tuple[str, int] | None:
    size, data, head = u32(b, at + 2), u32(b, at + 10), u32(b, at + 14)
    if at + 54 > len(b) or head not in (40, 52, 56, 108, 124) or not 14 + head <= data <= size or at + size > len(b):
        return None
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    return ("bmp", size) if planes == 1 and bits in (1, 4, 8, 16, 24, 32) else None


def pdf(b: bytes, at: int) -> tuple[str, int] | None:
    following = b.find(b"%PDF-", at + 5)  # so that every byte is looked at for one signature only
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return ("pdf", end + 5 - at) if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def gzip(b: bytes, at: int) -> tuple[str, int] | None:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):
            piece = d.unconsumed_tail or b[p : p + 65536]
            p += 0 if d.unconsumed_tail else len(piece)
            d.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return ("gzip", p - len(d.unused_data) - at) if d.eof else None


def zipped(b: bytes, at: int) -> tuple[str, int] | None:
    end = next_place(b, b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset = u32(b, end + 12), u32(b, end + 16)
    note = struct.unpack_from("<H", b, end + 20)[0]
    return ("zip", end + 22 + note - at) if at + offset + size == end and end + 22 + note <= len(b) else None


def box(b: bytes, p: int) -> int:
    """The end of a box that stands at ``p``, 0 if none does."""
    n = u32(b, p, ">") if p + 8 <= len(b) else 0
    return p + n if n >= 8 and p + n <= len(b) and bytes(b[p + 4 : p + 8]).isalnum() else 0


def mp4_table(b: bytes, first: int) -> array:
    """For each place from ``first`` - 4 on, from the end backwards: where boxes in a row from there end, twice that, plus 1 if there is a movie box."""
    first = max(0, first - 4)
    ends = array("q", bytes(8 * (len(b) + 1 - first)))
    for p in range(len(b), first - 1, -1):
        end = box(b, p)
        ends[p - first] = ends[end - first] | (b[p + 4 : p + 8] == b"moov") if end else 2 * p
    return ends


def mp4(b: bytes, at: int) -> tuple[str, int] | None:
    if table := table_of("mp4", b, b"ftyp", mp4_table):
        end = table[at - max(0, b.find(b"ftyp") - 4)]
        return ("mp4", (end >> 1) - at) if end & 1 else None
    p, movie = at, False
    while end := box(b, p):
        movie = movie or b[p + 4 : p + 8] == b"moov"
        p = end
    return ("mp4", p - at) if movie else None


CHECKS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {"png": png, "gif": gif, "jpeg": jpeg, "riff": riff, "bmp": bmp, "pdf": pdf, "gzip": gzip, "zip": zipped, "mp4": mp4}
_automata: list = []


def automaton():
    if not _automata:
        a = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(MAGIC):
            a.add_word(magic.decode("latin-1"), k)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """Every confirmed media file in a blob, as (type, start, length), by start. A file inside another one is listed too."""
    found = {}
    for last, k in automaton().iter(blob.decode("latin-1")):
        magic, offset, kind = MAGIC[k]
        start = last + 1 - len(magic) - offset
        if start >= 0 and (hit := CHECKS[kind](blob, start)):
            found[start, hit[0]] = hit[1]
    return [(kind, start, n) for (start, kind), n in sorted(found.items())]


def correct_types(df: DataFrame, blob_col: str, declared_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The confirmed type of each blob, whether the declared one was wrong, and the media carved from inside.

    A blob's type is that of the confirmed file at its start; ``application/octet-stream`` if there is none or the blob is null or
    empty. Each other confirmed file (also behind the first one's end) is carved. Returns ``keep``, media_type, corrected
    (the declared type is null or differs), embedded (type, start, bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, fixed, inner = [], [], []
            for blob, said in zip(batch.column("__blob").to_pylist(), batch.column("__said").to_pylist(), strict=True):
                all_ = sniff(blob or b"")
                kind = next((TYPES[k] for k, at, _ in all_ if at == 0), "application/octet-stream")
                kinds.append(kind)
                fixed.append(kind != said)
                inner.append([{"media_type": TYPES[k], "start": at, "content": blob[at : at + n]} for k, at, n in all_ if at])
            part = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("content", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(inner, part)], [*keep, "media_type", "corrected", "embedded"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "media_type string, corrected boolean, embedded array<struct<media_type:string,start:long,content:binary>>"
    return df.select(*keep, F.col(blob_col).cast("binary").alias("__blob"), F.col(declared_col).alias("__said")).mapInArrow(run, schema)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Bytes as unsigned 8-bit samples of one channel. An even number of bytes needs no padding."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples(blob: bytes, start: int = 0) -> bytes:
    """The samples of a confirmed WAV file."""
    at, n = dict(riff_chunks(blob, start))[b"data"]
    return blob[at : at + n]


def store_texts(docs: DataFrame, unit: int = 192, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text's UTF-8 bytes, padded with spaces to a positive multiple of ``unit``, stored as a WAV file and read back.

    The stored blob goes through the same sniffing as any other: its type is confirmed from its own bytes, the payload is read from the data chunk
    that the validator found, and media that the text itself contains are carved. ``feature`` tells type, samples, mean
    sample and carved media. Null texts count as empty. With ``keep_media`` the stored bytes are returned in ``media``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "__text"):
            rows: dict[str, list] = {c: [] for c in names[1:]}
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass")
                size = max(1, -(-len(raw) // unit)) * unit
                blob = to_wav(raw.ljust(size, b" "))
                found = sniff(blob)
                assert found and found[0] == ("wav", 0, len(blob))
                back = samples(blob, found[0][1])
                inner = ",".join(f"{k}@{at}+{n}" for k, at, n in found[1:])
                mean = sum(back) / len(back)
                values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), f"audio/wav samples={len(back)} mean={mean:.4f} embedded=[{inner}]", blob)
                for c, v in zip(rows, values, strict=False):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[c], kinds[c]) for c in rows]], names)

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()} | ({"media": pa.binary()} if keep_media else {})
    names = [id_col, *kinds]
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {sql[k]}" for c, k in kinds.items())
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)
