"""What can still be read of damaged compressed payloads.

A payload is a row of frames: members of a gzip file, or frames of a zstd file. Each stands by itself. A frame that cannot be
decoded is passed over, and reading goes on at the next place where a frame begins, that is, at its first bytes within a valid header; so zeroed pieces in the middle and a missing
end cost the frames they touch. Every break is reported with the byte at which its frame starts.

Decoding a file is one after the other by nature, so a file is the unit of work; files are read by Spark's own
reader and dealt over tasks. A file must fit a task: Spark reads up to 2 GB into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.sources.jsonl import arrival

FRAMES = "file string, bytes long, frame long, start long, row long, line string, broken string"


def payloads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, content) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content")


def read_frames(files: DataFrame, partial: bool = True, at_a_time: int = 4096) -> DataFrame:
    """Rows of (file, content) as (file, bytes, frame, start, row, line, broken): one row for each line, numbered within its
    frame, and one without a line for each break, which says what was wrong.

    ``frame`` counts the frames that begin in the file, broken ones too. With ``partial`` the whole lines before a break count;
    else a broken frame gives none, at the price of decoding every frame twice. A null or empty content has no rows, nor has one
    in which no frame begins; blank lines are left out by ``salvaged``.
    """

    def run(batches):
        # one closure without names of this package, so that it travels to the workers by itself
        import zlib

        import pyarrow as pa

        kinds = (b"\x1f\x8b\x08", b"\x28\xb5\x2f\xfd")

        def decoder(content, start):
            if content.startswith(kinds[0], start):
                return zlib.decompressobj(31)
            import zstandard

            return zstandard.ZstdDecompressor(max_window_size=2**27).decompressobj()

        def decoded(content, start):
            """Pieces of a frame's text, at last where it ends; an exception where it breaks."""
            one, at = decoder(content, start), start
            while at < len(content):
                piece = content[at : at + (1 << 20)]
                out = one.decompress(piece)
                if out:
                    yield out, None
                at += len(piece)
                if one.eof:
                    yield b"", at - len(one.unused_data)
                    return
            raise EOFError("the file ends within the frame")

        def lines_of(content, start):
            """Whole lines, then (None, end)."""
            rest = b""
            for out, end in decoded(content, start):
                parts = (rest + out).split(b"\n")
                rest = parts.pop()
                for line in parts:
                    yield line, None
                if end is not None:
                    if rest:
                        yield rest, None
                    yield None, end

        def plausible(content, start):
            """Whether a header is as its format demands; the first bytes alone turn up by chance in every 16 MB of packed data."""
            head = content[start : start + 10]
            if head.startswith(kinds[1]):
                return len(head) < 5 or not head[4] & 8
            flags, level, system = head[3:4] or b"\0", head[8:9] or b"\0", head[9:10] or b"\0"
            return flags[0] < 32 and level[0] in (0, 2, 4) and (system[0] < 14 or system[0] == 255)

        def rows_of(file, content):
            at, frame, broken, ahead = 0, 0, False, [-1] * len(kinds)
            while True:
                # where the next frame of each kind begins: right here by its first bytes, further on by its whole header
                for k, kind in enumerate(kinds):
                    if ahead[k] < at:
                        p = content.find(kind, at)
                        while p >= 0 and (p > at or broken) and not plausible(content, p):
                            p = content.find(kind, p + 1)
                        ahead[k] = p if p >= 0 else len(content)
                start, end, row = min(ahead), None, 0
                if start == len(content):
                    return
                try:
                    if not partial:
                        for _ in decoded(content, start):
                            pass
                    for line, end in lines_of(content, start):
                        if line is not None:
                            yield file, len(content), frame, start, row, line.decode("utf-8", "replace"), None
                            row += 1
                except Exception as e:  # whatever a decoder says of broken bytes
                    yield file, len(content), frame, start, row, None, f"{type(e).__name__}: {e}"
                    end = None
                at, broken = (start + 1, True) if end is None else (end, False)
                frame += 1

        names = ("file", "bytes", "frame", "start", "row", "line", "broken")
        kinds_of = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        schema = pa.schema(list(zip(names, kinds_of)))
        held = []
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(1)[k].as_py()
                for row in rows_of(batch.column(0)[k].as_py(), content or b""):
                    held.append(row)
                    if len(held) >= at_a_time:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds_of)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds_of)], schema=schema)

    return files.select("file", "content").mapInArrow(run, FRAMES)


def salvaged(frames: DataFrame, release_rank: int = 1) -> DataFrame:
    """The lines (seq, line, file) of frames, as ``read_lines`` gives them of whole files."""
    rows = frames.filter(F.col("line").isNotNull())
    seq = arrival(release_rank, F.col("file"), F.col("start")).dropFields("row").withField("row", F.col("row"))
    return rows.select(seq.alias("seq"), strip(F.col("line")).alias("line"), "file").filter(F.length("line") > 0)


def breaks(frames: DataFrame) -> DataFrame:
    """(file, bytes, frame, start, lines, broken): every break, the byte at which its frame starts and the lines read of it."""
    return frames.filter(F.col("broken").isNotNull()).select("file", "bytes", "frame", "start", F.col("row").alias("lines"), "broken")
