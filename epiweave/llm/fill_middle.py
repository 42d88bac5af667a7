"""Fill-in-the-middle transformation over seekable zstandard frames with cumulative unit counts (operator 13)."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, portions, stage, table

MARKS = (b"<P>", b"<S>", b"<M>")
FRAME = "units_before long, units long, chars long, data binary"
STORED = f"doc_id long, n long, marked boolean, frames array<struct<{', '.join(f.replace(' ', ':') for f in FRAME.split(', '))}>>"


def n_chars(text: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue another."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def cut_at(text: bytes, frame_bytes: int) -> Iterator[bytes]:
    """Pieces of whole lines of about frame_bytes; a longer line is a piece of its own."""
    at = 0
    while at < len(text):
        end = text.rfind(b"\n", at, at + frame_bytes) + 1 or text.find(b"\n", at) + 1 or len(text)
        if len(text) - at <= frame_bytes:
            end = len(text)
        yield text[at:end]
        at = end


def n_lines(text: bytes) -> int:
    return text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))


def store(docs: DataFrame, frame_bytes: int = 1 << 16, level: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, marked, frames): each text as independent zstandard frames of whole lines.

    A frame is (units_before, units, chars, data): the lines of the text before it, its lines and code
    points, and the compressed bytes, so a line is found by bisection and read from its frame alone. n is the
    number of lines; marked tells whether the text holds one of MARKS. Null text counts as empty: no frames.
    """

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        for b in (b.slice(at, k) for b in batches for at, k in portions(b.column("text"))):
            rows = {"doc_id": b.column("doc_id").to_pylist(), "n": [], "marked": [], "frames": []}
            for text in binary_column(b, "text"):
                frames, before = [], 0
                for piece in cut_at(text, frame_bytes):
                    units = n_lines(piece)
                    frames.append({"units_before": before, "units": units, "chars": n_chars(piece), "data": packer.compress(piece)})
                    before += units
                rows["n"].append(before)
                rows["marked"].append(any(m in text for m in MARKS))
                rows["frames"].append(frames)
            yield pa.RecordBatch.from_pydict(rows, _schema(STORED_FIELDS))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED)


_FRAME = pa.struct([("units_before", pa.int64()), ("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
STORED_FIELDS = (("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(_FRAME)))
OUT_FIELDS = (("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary())))
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows."""
    return (b.slice(at, rows) for b in batches for at in range(0, len(b), rows))


def _schema(fields) -> pa.Schema:
    return pa.schema(list(fields))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of seed:doc_id; a null doc_id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def split(frames: list[dict], first: int, second: int, packer, opener) -> tuple[list[list[bytes]], list[int]]:
    """The frames before line `first`, from there to line `second`, and after, with the code points of the first two.

    Only the frames that are cut are decompressed; the others pass as they are.
    """
    parts, chars = [[], [], []], [0, 0, 0]
    cuts = (first, second)
    inside = {i for c in cuts if (i := bisect_right(frames, c, key=lambda f: f["units_before"]) - 1) >= 0 and frames[i]["units_before"] < c < frames[i]["units_before"] + frames[i]["units"]}
    for i, f in enumerate(frames):
        before, after = f["units_before"], f["units_before"] + f["units"]
        if i not in inside:
            to = sum(before >= c for c in cuts)
            parts[to].append(f["data"])
            chars[to] += f["chars"]
            continue
        text = opener.decompress(f["data"])
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        bounds = [0, *(int(ends[c - before - 1]) if before < c < after else (0 if c <= before else len(text)) for c in cuts), len(text)]
        for to, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < z:
                parts[to].append(packer.compress(text[a:z]))
                chars[to] += n_chars(text[a:z])
    return parts, chars


def transform(stored: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, level: int = 3) -> DataFrame:
    """`store`'s rows -> (doc_id, n, form, prefix_chars, middle_chars, output): texts rearranged around two drawn lines.

    The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) lines, the middle after the larger.
    form is plain for empty and marked texts and where h3 % 100 >= rate, else spm where h4 % 100 < spm, else
    psm. output is the new text as zstandard frames, whose concatenation any reader can decompress:
    `<P>`prefix`<S>`suffix`<M>`middle for psm, `<S>`suffix`<P>`prefix`<M>`middle for spm; marks are frames
    of their own, and frames without a cut are those of the store.

    Null and repeated doc_ids draw alike for each row; rows stay apart. An empty table gives no rows.
    """

    def run(batches):
        packer, opener = zstandard.ZstdCompressor(level=level, write_checksum=False), zstandard.ZstdDecompressor()
        mark = {m: packer.compress(m) for m in MARKS}
        for b in few(batches):
            rows = {name: [] for name, _ in OUT_FIELDS}
            for doc_id, n, marked, frames in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "marked", "frames")), strict=True):
                h1, h2, h3, h4 = draws(doc_id, seed)
                cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                if not n or marked or h3 % 100 >= rate:
                    form, chars, output = "plain", [None, None], [f["data"] for f in frames]
                else:
                    (prefix, middle, suffix), chars = split(frames, *cuts, packer, opener)
                    form = "spm" if h4 % 100 < spm else "psm"
                    first = [mark[b"<P>"], *prefix, mark[b"<S>"], *suffix] if form == "psm" else [mark[b"<S>"], *suffix, mark[b"<P>"], *prefix]
                    output = [*first, mark[b"<M>"], *middle]
                for name, value in zip(rows, (doc_id, n, form, chars[0], chars[1], output), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, _schema(OUT_FIELDS))

    return stored.select("doc_id", "n", "marked", "frames").mapInArrow(run, OUT)


def restored_order(texts: Iterator[bytes], form: str) -> list[int]:
    """Places of an output's frames in the order of the text: the marks, which no text holds, tell the parts apart."""
    if form == "plain":
        return [i for i, _ in enumerate(texts)]
    part, at = {m: [] for m in MARKS}, None
    for i, text in enumerate(texts):
        if text in MARKS:
            at = text
        else:
            part[at].append(i)
    return [*part[b"<P>"], *part[b"<M>"], *part[b"<S>"]]


def texts(outputs: DataFrame) -> DataFrame:
    """Adds text, the new text, and restored, the text before, both from output and form alone, as strings."""

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for b in few(batches):
            new, old = [], []
            for form, frames in zip(b.column("form").to_pylist(), b.column("output").to_pylist(), strict=True):
                pieces = [opener.decompress(f) for f in frames]
                new.append(b"".join(pieces))
                old.append(b"".join(pieces[i] for i in restored_order(iter(pieces), form)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.binary()), pa.array(old, pa.binary())], [*b.schema.names, "text", "restored"])

    out = outputs.mapInArrow(run, f"{OUT}, text binary, restored binary")
    return out.withColumns({"text": F.col("text").cast("string"), "restored": F.col("restored").cast("string")})


def with_digests(outputs: DataFrame) -> DataFrame:
    """Replaces output by output_sha256 and restored_sha256, streamed frame by frame: one frame's text is held at a time.

    The restored digest reads the output's frames again in the text's order, which the marks and the form give.
    """

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for b in few(batches):
            new, old = [], []
            for form, frames in zip(b.column("form").to_pylist(), b.column("output").to_pylist(), strict=True):
                whole = hashlib.sha256()

                def streamed(frames=frames, whole=whole):
                    for f in frames:
                        text = opener.decompress(f)
                        whole.update(text)
                        yield text

                order, back = restored_order(streamed(), form), hashlib.sha256()
                for i in order:
                    back.update(opener.decompress(frames[i]))
                new.append(whole.hexdigest())
                old.append(back.hexdigest())
            kept = [c for c in b.schema.names if c != "output"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(new, pa.string()), pa.array(old, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, OUT.replace("output array<binary>", "output_sha256 string, restored_sha256 string"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are stored as frames in a table of the shared folder, which the transformation reads."""
    stored = stage(store(table(spark, sf_dir, "documents")), "frames")
    return with_digests(transform(stored))


_ID = "coalesce(CAST(doc_id AS VARCHAR), '')"
_FIRST = lambda k: f"CASE WHEN {k} = 0 THEN '' WHEN {k} = n THEN t ELSE array_to_string(list_slice(lines, 1, {k}), chr(10)) || chr(10) END"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || {_ID}) AS h FROM documents),
n AS (SELECT *, string_split(t, chr(10)) AS lines, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND t[-1] <> chr(10) THEN 1 ELSE 0 END AS n,
    {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z FROM n),
p AS (SELECT *, {_FIRST("a")} AS head, {_FIRST("z")} AS most, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
m AS (SELECT *, substr(most, length(head) + 1) AS mid, substr(t, length(most) + 1) AS tail FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM m"""
