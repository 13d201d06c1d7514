"""Readers of sequence and table files (S1-S10). Text sources are parsed with built-in functions; gzip is read by extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strain_name(path: Column) -> Column:
    """Base name up to the first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def fasta_records(df: DataFrame, text: str = "value") -> DataFrame:
    """(…, contig, seq) of each record of FASTA texts (S2); lines of a sequence are joined, a text before the first > is left out."""
    rest = [c for c in df.columns if c != text]
    rec = df.select(*rest, F.explode(F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>"), 2, 1 << 30)).alias("_rec"))
    head = F.substring_index(F.col("_rec"), "\n", 1)
    body = F.substring(F.col("_rec"), F.length(head) + 1, F.length("_rec"))
    return rec.select(*rest, F.element_at(F.split(F.trim(F.regexp_replace(head, "\r", "")), r"\s+"), 1).alias("contig"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_genomes(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("fna", "fa", "fasta")) -> DataFrame:
    """genome(strain, contig, seq) of a folder of FASTA files, one a strain, plain or .gz."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    files = files.where(F.col("file").rlike(r"\.(" + "|".join(extensions) + r")(\.gz)?$"))
    return fasta_records(files.withColumn("strain", strain_name(F.col("file"))).drop("file"))


#: Letters of one slice of a sequence.
SLICE = 1 << 20


def read_genome_slices(spark: SparkSession, path: str, k: int, extensions: tuple[str, ...] = ("fna", "fa", "fasta"), size: int = SLICE, by: str | None = None) -> DataFrame:
    """(strain, seq) of a folder of FASTA files of any size, one a strain (S2, S3): pieces whose k-mers of A, C, G and T are those of
    all records, each as often as there.

    Lines are streamed split by split, so a contig is read by as many tasks as it has splits and held whole by none. Slices overlap by
    k - 1 letters. What a record has beside a split's border goes through a small aggregate: its k - 1 first and last letters there, an
    N between them, put together in order; so the k-mers that span borders are found in a row of their own. Text before the first
    record of a file is left out. by: the folders `by=...` that files lie in name the strains, not the files."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value", F.col("_metadata.file_name").alias("name"))
    lines = lines.where(F.col("name").rlike(r"\.(" + "|".join(extensions) + r")(\.gz)?$"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []  # file, split, place, begins a record, text; a slice has no split
        now, place, begun, early = None, 0, False, True
        parts: list[str] = []
        have, head, done = 0, "", 0

        def cut() -> None:
            """Slices of what has come; the overlap with the next stays."""
            nonlocal parts, have, head, done
            text = "".join(parts)
            if done == 0:
                head = text[: 2 * k]
            while len(text) >= size + k:
                out.append((now[0], None, None, None, text[: size + k - 1]))
                text, done = text[size:], done + size
            parts, have = [text], len(text)

        def close(border: bool) -> None:
            """The end of a record's run of lines in a split; border: it goes on in another split, before or after."""
            nonlocal parts, have, head, done, place
            cut()
            text, whole = parts[0], done + have
            short = whole <= 2 * (k - 1)
            if have >= k and not (border and short):
                out.append((now[0], None, None, None, text))
            if border:
                ends = (head if short else head[: k - 1] + "N" + text[len(text) - k + 1 :]) if k > 1 else ""
                out.append((now[0], now[1], place, begun, ends))
            place, parts, have, head, done = place + 1, [], 0, "", 0

        for b in it:
            for file, start, line in zip(*(b.column(c).to_pylist() for c in ("file_path", "file_block_start", "value")), strict=True):
                if (file, start) != now:
                    if now:
                        close(True)
                    now, place, begun, early = (file, start), 0, False, True
                if line.startswith(">"):
                    close(early and (begun or now[1] > 0))
                    begun, early = True, False
                elif begun or now[1] > 0:
                    parts.append("".join(line.split()))
                    have += len(parts[-1])
                    if have > 2 * (size + k):
                        cut()
            if out:
                yield batch(out)
                out = []
        if now:
            close(True)
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "split": pa.int64(), "place": pa.int32(), "begins": pa.bool_(), "seq": pa.string()}
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    got = lines.drop("name").mapInArrow(run, "file string, split long, place int, begins boolean, seq string")
    w = Window.partitionBy("file").orderBy("split", "place")
    edge = got.where("split is not null").withColumn("record", F.sum(F.col("begins").cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "seq"))), lambda x: x["seq"]), "")
    edge = edge.groupBy("file", "record").agg(text.alias("seq")).where(F.length("seq") >= k).select("file", "seq")
    return got.where("split is null").select("file", "seq").unionByName(edge).select((F.regexp_extract("file", f"/{by}=([^/]*)/", 1) if by else strain_name(F.col("file"))).alias("strain"), "seq")


def fastq_records(df: DataFrame, text: str = "value") -> DataFrame:
    """(…, read_id, seq, qual) of FASTQ texts of four lines a record."""
    rest = [c for c in df.columns if c != text]
    lines = F.split(F.regexp_replace(F.rtrim(F.col(text)), "\r", ""), "\n")
    x = df.where(F.length(F.trim(F.col(text))) > 0).select(*rest, lines.alias("_l"))
    x = x.select(*rest, "_l", F.explode(F.sequence(F.lit(1), F.size("_l") - 3, F.lit(4))).alias("_i"))
    line = lambda j: F.element_at("_l", F.col("_i") + j)
    return x.select(*rest, F.substring_index(F.substring(line(0), 2, 1 << 30), " ", 1).alias("read_id"), line(1).alias("seq"), line(3).alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, qual) of FASTQ files of any size, plain or .gz, four lines a record.

    Lines are streamed split by split; how many lines come before a split of its file, one row a split, says which line of a record
    it begins with. Records that two splits share, one a split at most, are put together by a small aggregate. A plain file is read
    by as many tasks as it has splits, a .gz file by one."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    size: dict[str, list[tuple[int, int]]] = {}
    for r in lines.groupBy("file_path", "file_block_start").agg(F.count("*").alias("n")).collect():
        size.setdefault(r.file_path, []).append((r.file_block_start, r.n))
    first = {}
    for file, splits in size.items():
        at = 0
        for start, n in sorted(splits):
            first[file, start] = at
            at += n
    before = spark.sparkContext.broadcast(first)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, open_ = None, 0, []
        for b in it:
            whole: list[tuple[str, str, str]] = []
            part: list[tuple[str, int, int, str]] = []
            for file, start, line in zip(*(b.column(c).to_pylist() for c in ("file_path", "file_block_start", "value")), strict=True):
                if (file, start) != now:
                    part += open_
                    now, number, open_ = (file, start), before.value[file, start], []
                open_.append((file, number // 4, number % 4, line.rstrip("\r")))
                number += 1
                if number % 4 == 0:
                    if len(open_) == 4:
                        whole.append((open_[0][3], open_[1][3], open_[3][3]))
                    else:
                        part += open_
                    open_ = []
            yield rows(whole, part)
        yield rows([], open_)

    def rows(whole: list, part: list) -> pa.RecordBatch:
        all_ = [(None, None, None, None, *w) for w in whole] + [(*p, None, None, None) for p in part]
        cols = list(zip(*all_, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["file", "record", "line", "text", "head", "seq", "qual"])

    got = lines.mapInArrow(run, "file string, record long, line int, text string, head string, seq string, qual string")
    line = lambda i: F.max(F.when(F.col("line") == i, F.col("text")))
    cut = got.where("record is not null").groupBy("file", "record").agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"), F.count("*").alias("n")).where("n = 4")
    out = got.where("record is null").select("head", "seq", "qual").unionByName(cut.select("head", "seq", "qual"))
    return out.select(F.substring_index(F.substring(F.col("head"), 2, 1 << 30), " ", 1).alias("read_id"), "seq", "qual")


def read_reads(spark: SparkSession, sample: str, *paths: str) -> DataFrame:
    """reads(sample, mate, read_id, seq, qual) of one file, or two of a pair, plain or .gz."""
    out = None
    for mate, path in enumerate(paths, 1):
        one = read_fastq(spark, path).select(F.lit(sample).alias("sample"), F.lit(mate).alias("mate"), "read_id", "seq", "qual")
        out = one if out is None else out.unionByName(one)
    return out


def matrix_text(df: DataFrame, text: str = "value") -> DataFrame:
    """pair(a, b, value) of square tab-separated matrices whose first line names the columns (S5), one a row."""
    x = df.select(F.split(F.rtrim(text), "\n").alias("l"))
    x = x.select(F.split(F.element_at("l", 1), "\t").alias("names"), F.posexplode(F.slice("l", 2, 1 << 30)).alias("i", "row"))
    x = x.select("names", F.split("row", "\t").alias("cells"))
    x = x.select("names", F.element_at("cells", 1).alias("a"), F.posexplode(F.slice("cells", 2, 1 << 30)).alias("j", "v"))
    return x.select(strain_name(F.col("a")).alias("a"), strain_name(F.element_at(F.col("names"), F.col("j") + 2)).alias("b"), F.col("v").cast("double").alias("value"))


def matrix_pairs(spark: SparkSession, path: str) -> DataFrame:
    return matrix_text(spark.read.text(path, wholetext=True))


def id_matrix(rows: DataFrame, ids: DataFrame, row: str = "row", text: str = "value") -> DataFrame:
    """(row, kmer) of a sparse matrix in text and its id list (S9). rows: a line of positions, with spaces, for each row; ids: pos, kmer."""
    at = rows.select(row, F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("pos")).where("pos <> ''").withColumn("pos", F.col("pos").cast("long"))
    return at.join(ids.select("pos", "kmer"), "pos").select(row, "kmer")


def cluster_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """cluster(cluster, strain) of lines id, size, member list (S6; a clustering of the user's own is read the same way, S7)."""
    p = F.split(F.col(text), "\t")
    return df.select(F.element_at(p, 1).cast("long").alias("cluster"), F.explode(F.split(F.element_at(p, 3), ",")).alias("strain"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return cluster_lines(spark.read.text(path))


def tree_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """node(id, parent, children, strain) of lines with N for none."""
    p = F.split(F.col(text), "\t")
    none = lambda c: F.when(c != "N", c)
    kids = F.transform(F.split(none(F.element_at(p, 3)), " "), lambda x: x.cast("long"))
    return df.select(F.element_at(p, 1).cast("long").alias("id"), none(F.element_at(p, 2)).cast("long").alias("parent"), kids.alias("children"), none(F.get(p, F.lit(3))).alias("strain"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return tree_lines(spark.read.text(path))


def block_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """block(block, strain, strand, start, end) of GFF lines, starts counted from 0."""
    p = F.split(F.col(text), "\t")
    x = df.where(~F.col(text).startswith("#") & (F.size(p) >= 9))
    return x.select(F.regexp_extract(F.element_at(p, 9), ".*=(.*)", 1).alias("block"), F.element_at(p, 1).alias("strain"), F.element_at(p, 7).alias("strand"), (F.element_at(p, 4).cast("long") - 1).alias("start"), F.element_at(p, 5).cast("long").alias("end"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return block_lines(spark.read.text(path))
