"""Chunking of documents and position weights, all in one expression a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numbers import col


def sliding(text, size: int = 512, overlap: int = 128) -> Column:
    """array<struct(start, end, text)>: windows of words split at blanks, offsets in words; ends with the window that reaches the last word."""
    words = F.filter(F.split(col(text), " "), lambda w: w != "")
    n, step = F.size(words), max(1, size - overlap)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    one = lambda s: F.struct(s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("text"))
    return F.transform(starts, one)


def _pack(pieces: Column, joiner: str, least: int, most: int, between: int) -> Column:
    """Pieces packed in order until the next would pass ``most``; what is left at the end goes if it is shorter than ``least``.

    Lengths count ``between`` characters after each piece, offsets likewise.
    """
    chunk = "struct<start:int,end:int,text:string>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("len"), F.lit(0).alias("at"))
    done = lambda a: F.struct(a["at"].alias("start"), (a["at"] + a["len"]).alias("end"), F.array_join(a["cur"], joiner).alias("text"))

    def step(a: Column, p: Column) -> Column:
        full = (a["len"] + F.length(p) > most) & (F.size(a["cur"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(done(a)))).otherwise(a["out"]).alias("out"),
            F.when(full, F.array(p)).otherwise(F.concat(a["cur"], F.array(p))).alias("cur"),
            (F.when(full, 0).otherwise(a["len"]) + F.length(p) + between).cast("int").alias("len"),
            F.when(full, a["at"] + a["len"]).otherwise(a["at"]).cast("int").alias("at"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.when((F.size(a["cur"]) > 0) & (a["len"] >= least), F.concat(a["out"], F.array(done(a)))).otherwise(a["out"]))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def by_sentence(text, least: int = 100, most: int = 1000) -> Column:
    return _pack(_trimmed(F.split(col(text), r"(?<=[.!?])\s+")), " ", least, most, 1)


def by_paragraph(text, least: int = 100, most: int = 2000) -> Column:
    return _pack(_trimmed(F.split(col(text), r"\n\n|\r\n\r\n")), "\n\n", least, most, 2)


def by_section(text, level: int = 2, most: int = 2000) -> Column:
    """array<struct(heading, level, text)>: a section each heading of the level or above; text before the first goes.

    Longer sections are packed by paragraph; without headings all is, with null headings.
    """
    mark = f"(?m)^(?=#{{1,{level}}}\\s+\\S)"
    parts = F.filter(F.split(col(text), mark), lambda p: p.rlike(f"^#{{1,{level}}}\\s+\\S"))
    head = lambda p: F.regexp_extract(p, rf"^#{{1,{level}}}\s+(.+)", 1)
    rank = lambda p: F.length(F.regexp_extract(p, r"^(#+)", 1))
    trim = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")

    def section(p: Column) -> Column:
        whole = F.array(F.struct(head(p).alias("heading"), rank(p).alias("level"), trim(p).alias("text")))
        return F.when(F.length(trim(p)) <= most, whole).otherwise(F.transform(by_paragraph(trim(p), most=most), lambda c: F.struct(head(p).alias("heading"), rank(p).alias("level"), c["text"].alias("text"))))

    none = F.transform(by_paragraph(text, most=most), lambda c: F.struct(F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("level"), c["text"].alias("text")))
    return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, section))).otherwise(none)


def recursive(text, target: int = 500, least: int = 100, most: int = 1000) -> Column:
    """array<string>: whole if it fits; else its paragraphs, of each that doesn't fit the packed sentences (short ends go), or windows of words where there is one sentence alone."""

    def sentences(t: Column) -> Column:
        parts = F.split(t, r"(?<=[.!?])\s+")
        packed = F.filter(F.transform(_pack(parts, " ", 0, target, 1), lambda c: c["text"]), lambda c: F.length(c) >= least)
        return F.when(F.size(parts) > 1, packed).otherwise(F.transform(sliding(t, target, target // 4), lambda c: c["text"]))

    fits = lambda t: F.when(F.length(t) <= most, F.array(t)).otherwise(sentences(t))
    paragraphs = F.filter(F.split(col(text), r"\n\n"), lambda p: p != "")
    t = col(text)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(F.flatten(F.transform(paragraphs, fits)))


#: kind -> (end of the beginning, begin of the end, weights of beginning, end and middle)
POSITIONS = {"unknown": (0.12, 0.88, 1.3, 1.2, 1.0), "expository": (0.15, 0.85, 1.5, 1.4, 1.0), "narrative": (0.10, 0.90, 1.1, 1.2, 1.0)}


def position_weight(index, count, kind="unknown") -> Column:
    """Weight of chunk ``index`` of ``count``, by the kind of content."""
    at, out = col(index) / col(count), None
    for name, (a, b, first, last, middle) in POSITIONS.items():
        w = F.when(at < a, first).when(at >= b, last).otherwise(middle)
        is_kind = (F.lit(kind) if isinstance(kind, str) and kind in POSITIONS else col(kind)) == name
        out = F.when(is_kind, w) if out is None else out.when(is_kind, w)
    return out.otherwise(1.0)


def chunk_rows(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "chunk")).select(key, "chunk_index", "chunk.*")


def weighted(chunks: DataFrame, key: str = "doc_id", kind: str = "unknown") -> DataFrame:
    """Chunk rows with the weight of their position."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return chunks.withColumn("weight", position_weight("chunk_index", n, kind))
