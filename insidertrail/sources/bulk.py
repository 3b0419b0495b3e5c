"""Quarterly bulk filing tables (tab-separated members) to typed facts."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import IO, TextIO

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators.staged import written

MEMBERS = {
    "SUBMISSION": ["ACCESSION_NUMBER", "DOCUMENT_TYPE", "FORM_TYPE", "ISSUERCIK", "ISSUERNAME",
                   "ISSUERTRADINGSYMBOL", "FILING_DATE", "PERIOD_OF_REPORT", "AFF10B5ONE", "REMARKS"],
    "REPORTINGOWNER": ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP",
                       "RPTOWNER_TITLE"],
    "NONDERIV_TRANS": ["ACCESSION_NUMBER", "TRANS_CODE", "TRANS_DATE", "TRANS_SHARES",
                       "TRANS_PRICEPERSHARE", "TRANS_ACQUIRED_DISP_CD", "SHRS_OWND_FOLWNG_TRANS",
                       "SECURITY_TITLE"],
    "DERIV_TRANS": ["ACCESSION_NUMBER", "DERIV_TRANS_SK", "SECURITY_TITLE", "TRANS_DATE", "TRANS_CODE",
                    "CONV_EXERCISE_PRICE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_ACQUIRED_DISP_CD",
                    "EXCERCISE_DATE", "EXPIRATION_DATE", "UNDLYNG_SEC_SHARES", "SHRS_OWND_FOLWNG_TRANS",
                    "TRANS_TIMELINESS"],
    "FOOTNOTES": ["ACCESSION_NUMBER", "FOOTNOTE_ID", "FOOTNOTE_TXT"],
}


def _cells(text: Iterable[str], member: str) -> Iterator[pd.DataFrame]:
    """Rows of one member by the names in its own header, some at a time.

    Cells may be quoted and then hold tabs, line breaks and doubled quotes.  A short row has NULL tail cells,
    surplus cells and unknown columns are ignored, a column the header lacks is NULL.
    """
    csv.field_size_limit(2 ** 31 - 1)
    rows = csv.reader(text, delimiter="\t")
    at = {name: i for i, name in enumerate(next(rows, []))}
    wanted = [at.get(name) for name in MEMBERS[member]]
    some: list[list] = []
    for row in rows:
        if row:
            some.append([row[i] if i is not None and i < len(row) else None for i in wanted])
        if len(some) == 20_000:
            yield pd.DataFrame(some, columns=MEMBERS[member], dtype=object)
            some = []
    if some:
        yield pd.DataFrame(some, columns=MEMBERS[member], dtype=object)


def _schema(member: str) -> str:
    return ", ".join(f"{c} string" for c in MEMBERS[member])


def read_archives(spark: SparkSession, archives: str, member: str) -> DataFrame:
    """Named text columns of one member of every archive under a path, in one pass over each archive.

    An archive is one task's work; one without the member gives no rows.
    """
    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if f"{member}.tsv" in archive.namelist():
                        with archive.open(f"{member}.tsv") as handle:
                            yield from _cells(_decoded(handle), member)

    files = spark.read.format("binaryFile").load(archives).select("content")
    return files.mapInPandas(unpacked, _schema(member))


def _decoded(handle: IO[bytes]) -> TextIO:
    return io.TextIOWrapper(handle, encoding="utf-8", errors="replace", newline="")


# --- large members, cut anywhere ----------------------------------------------
#
# Spark's text reader cuts a file into splits and gives each line to the split it begins in.  Whether a line begins a
# record depends on the quotes before it.  A first pass tells of every split how it ends if it begins outside and if it
# begins inside a quoted cell; put one after the other these settle where each split begins.  A second pass parses.


def _ends_quoted(line: bytes, quoted: bool) -> bool:
    """Whether a line that begins inside (``quoted``) or outside a quoted cell ends inside one."""
    at = 0
    if not quoted:
        quoted = line.startswith(b'"')
        at = 1
        if not quoted:
            at = line.find(b'\t"') + 2
            quoted = at > 1
    while quoted:
        end = line.find(b'"', at)
        if end < 0:
            return True
        if line[end + 1:end + 2] == b'"':
            at = end + 2
            continue
        at = line.find(b'\t"', end + 1) + 2
        quoted = at > 1
    return False


Split = tuple[str, int]  # file, place of its first byte


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, Iterator[bytes]]]:
    """The lines of each split, in order; what is left of a split is skipped when the next one is asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for split, lines in groupby(rows, key=lambda r: (r[1], r[2])):
        yield split, (line or b"" for line, _, _ in lines)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: does it end quoted if it begins outside, or inside; does it leave the quotes; the file's first line."""
    for (path, start), lines in _by_split(batches):
        outside, inside, closes, first = False, True, False, None
        for line in lines:
            first = line if first is None else first
            if b'"' in line:
                outside, inside = _ends_quoted(line, outside), _ends_quoted(line, inside)
            closes = closes or not inside
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in ((path, pa.string()), (start, pa.int64()), (outside, pa.bool_()), (inside, pa.bool_()),
                                           (closes, pa.bool_()), (first if start == 0 else None, pa.binary()))],
            ["path", "start", "outside", "inside", "closes", "first"])


def _opened_before(ends: DataFrame) -> DataFrame:
    """(path, start, opener): the splits that begin inside a quoted cell, with the split in which its record began.

    For a file that ends inside one there is such a row with a null ``start``.
    """
    listed = ends.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "outside", "inside", "closes"))).alias("splits"))
    # A file has a split per hundred megabytes or so.  ``opener`` is null outside of quotes.
    begin = F.struct(F.array().cast("array<struct<start: bigint, opener: bigint>>").alias("found"), F.lit(None).cast("bigint").alias("opener"))

    def after(state: Column, s: Column) -> Column:
        opener = state["opener"]
        own = F.when(F.when(opener.isNull(), s["outside"]).otherwise(s["inside"]),
                     F.when(opener.isNull() | s["closes"], s["start"]).otherwise(opener))
        found = F.when(opener.isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(F.struct(s["start"].alias("start"), opener.alias("opener")))))
        return F.struct(found.alias("found"), own.alias("opener"))

    def with_end(state: Column) -> Column:
        end = F.array(F.struct(F.lit(None).cast("bigint").alias("start"), state["opener"].alias("opener")))
        return F.when(state["opener"].isNull(), state["found"]).otherwise(F.concat(state["found"], end))

    return listed.select("path", F.explode(F.aggregate("splits", begin, after, with_end)).alias("at")).select("path", "at.*")


def _records(path: str, start: int, lines: Iterator[bytes], opener: int | None) -> Iterator[tuple[int | None, bytes]]:
    """(opener, bytes): whole records with None; the beginning or end of a record of several splits with its first split."""
    held, quoted, whole = [], opener is not None, opener is None
    for line in lines:
        held.append(line)
        quoted = _ends_quoted(line, quoted) if quoted or b'"' in line else False
        if not quoted:
            yield (None if whole else opener), b"\n".join(held) + b"\n"
            held, whole = [], True
    if held:
        yield (start if whole else opener), b"\n".join(held) + b"\n"


def read_member(spark: SparkSession, directory: str, member: str) -> DataFrame:
    """One member of extracted archives, ``directory/*/MEMBER.tsv``; headers, of one line each, may differ from file to file.

    Files are read in splits, however large they are, and give the rows that ``csv.reader`` makes of them as a whole.
    A task holds some lines at a time; only a record that several splits share is put together from its parts.  What a
    file that ends inside a quoted cell has of its last record is a row, too; that cell then ends with a line end.
    A directory without the member gives an empty frame.
    """
    try:
        text = spark.read.text(f"{directory}/*/{member}.tsv", lineSep="\n")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _schema(member))
    lines = text.select(F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    ends = written(lines.mapInArrow(_split_ends, "path string, start bigint, outside boolean, inside boolean, closes boolean, first binary"), "splits")
    heads = {r["path"]: bytes(r["first"]) for r in ends.where("first is not null").select("path", "first").collect()}  # a line per file
    if any(_ends_quoted(line, False) for line in heads.values()):
        raise ValueError(f"a header of {member} goes on in a second line")
    opened = {(r["path"], r["start"]): r["opener"] for r in _opened_before(ends).collect()}  # splits that begin within a record
    shared = {(path, opener) for (path, _), opener in opened.items()}

    def cells(path: str, records: Iterator[bytes]) -> Iterator[pd.DataFrame]:
        header = heads[path] + b"\n"
        return _cells((r.decode("utf-8", "replace") for r in chain([header], records)), member)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), split in _by_split(batches):
            if start == 0:
                next(split)
            found = _records(path, start, split, opened.get((path, start)))
            for frame in cells(path, (r for opener, r in found if opener is None)):
                yield pa.RecordBatch.from_pandas(frame, pa.schema([(c, pa.string()) for c in MEMBERS[member]]), preserve_index=False)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), split in _by_split(batches):
            if (path, start) in opened or (path, start) in shared:
                if start == 0:
                    next(split)
                for opener, r in _records(path, start, split, opened.get((path, start))):
                    if opener is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([opener], pa.int64()), pa.array([start], pa.int64()),
                                                          pa.array([r], pa.binary())], ["path", "opener", "start", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                for frame in cells(path, iter([b"".join(pieces)])):
                    yield pa.RecordBatch.from_pandas(frame, pa.schema([(c, pa.string()) for c in MEMBERS[member]]), preserve_index=False)

    rows = lines.mapInArrow(parsed, _schema(member))
    if not opened:
        return rows
    # The same reading once more: one of fewer files could be cut into other splits.
    whole = (lines.mapInArrow(parts, "path string, opener bigint, start bigint, part binary").groupBy("path", "opener")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p["part"]).alias("pieces")))
    return rows.unionByName(whole.select("path", "pieces").mapInArrow(joined, _schema(member)))


def members_from_texts(texts: DataFrame, member: str) -> DataFrame:
    """Named text columns of member files held whole in a column ``text``."""
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"].dropna():
                yield from _cells(io.StringIO(text, newline=""), member)

    return texts.select("text").mapInPandas(parsed, _schema(member))


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def quarter_transactions(submissions: DataFrame, owners: DataFrame, trades: DataFrame,
                         tickers: DataFrame) -> DataFrame:
    """Form 4 rows of the wanted tickers, one per (transaction, owner)."""
    wanted = tickers.select(F.upper("ticker").alias("company_ticker")).distinct()
    doc_type = F.coalesce(F.nullif(F.col("DOCUMENT_TYPE"), F.lit("")), F.col("FORM_TYPE"))
    filings = (submissions.where(F.trim(doc_type) == "4").select(
        _text("ACCESSION_NUMBER").alias("acc"), S.strip_cik("ISSUERCIK").alias("company_cik"),
        _text("ISSUERNAME").alias("company_name"), F.upper(_text("ISSUERTRADINGSYMBOL")).alias("company_ticker"),
        S.day_month_year("FILING_DATE").alias("filing_date"), S.plan_flag("AFF10B5ONE").alias("is_10b5_1_plan"))
        .where(F.col("acc") != "").join(wanted, "company_ticker", "left_semi"))
    flags = S.relationship_flags("RPTOWNER_RELATIONSHIP")
    people = owners.select(
        _text("ACCESSION_NUMBER").alias("acc"), S.strip_cik("RPTOWNERCIK").alias("insider_cik"),
        _text("RPTOWNERNAME").alias("insider_name"), _text("RPTOWNER_TITLE").alias("officer_title"),
        *[c.alias(n) for n, c in flags.items()])
    shares = F.coalesce(S.safe_double("TRANS_SHARES"), F.lit(0.0))
    price = S.safe_double("TRANS_PRICEPERSHARE")
    title = S.blank_to_null("SECURITY_TITLE")
    code = _text("TRANS_CODE")
    moves = trades.select(
        _text("ACCESSION_NUMBER").alias("acc"), code.alias("transaction_code"),
        S.day_month_year("TRANS_DATE").alias("transaction_date"), shares.alias("shares"),
        price.alias("price_per_share"), S.total_value(shares, price).alias("total_value"),
        S.safe_double("SHRS_OWND_FOLWNG_TRANS").alias("shares_owned_after"),
        _text("TRANS_ACQUIRED_DISP_CD").alias("acquired_or_disposed"),
        S.is_discretionary(code).alias("is_discretionary"), title.alias("security_title"),
        S.is_common_stock(title).alias("is_common_stock")).where(F.col("transaction_code") != "")
    rows = moves.join(filings, "acc").join(people, "acc")
    key = S.transaction_key("acc", "transaction_code", "transaction_date", "shares")
    return rows.withColumn("accession_number", key).drop("acc")


def filing_meta(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        _text("ACCESSION_NUMBER").alias("accession_number"), S.day_month_year("FILING_DATE").alias("filing_date"),
        S.day_month_year("PERIOD_OF_REPORT").alias("period_of_report"),
        S.blank_to_null("REMARKS").alias("remarks"), F.lit("bulk_tsv").alias("source")
    ).where(F.col("accession_number") != "")


def derivative_rows(deriv: DataFrame) -> DataFrame:
    """Typed Table II rows; rows without accession or key are dropped."""
    return deriv.select(
        _text("ACCESSION_NUMBER").alias("accession_number"),
        F.trim("DERIV_TRANS_SK").try_cast("bigint").alias("deriv_trans_sk"),
        S.blank_to_null("SECURITY_TITLE").alias("security_title"), S.day_month_year("TRANS_DATE").alias("trans_date"),
        S.blank_to_null("TRANS_CODE").alias("trans_code"),
        S.safe_double("CONV_EXERCISE_PRICE").alias("conv_exercise_price"),
        S.safe_double("TRANS_SHARES").alias("trans_shares"),
        S.safe_double("TRANS_PRICEPERSHARE").alias("trans_price_per_share"),
        S.blank_to_null("TRANS_ACQUIRED_DISP_CD").alias("acquired_disposed"),
        S.day_month_year("EXCERCISE_DATE").alias("exercisable_date"),
        S.day_month_year("EXPIRATION_DATE").alias("expiration_date"),
        S.safe_double("UNDLYNG_SEC_SHARES").alias("underlying_shares"),
        S.safe_double("SHRS_OWND_FOLWNG_TRANS").alias("shares_owned_after"),
        S.blank_to_null("TRANS_TIMELINESS").alias("timeliness"),
    ).where((F.col("accession_number") != "") & F.col("deriv_trans_sk").isNotNull())


def footnote_rows(footnotes: DataFrame) -> DataFrame:
    return footnotes.select(
        _text("ACCESSION_NUMBER").alias("accession_number"), _text("FOOTNOTE_ID").alias("footnote_id"),
        _text("FOOTNOTE_TXT").alias("text")).where(
        (F.col("accession_number") != "") & (F.col("footnote_id") != "") & (F.col("text") != ""))
