"""Tables as arrays: linearising, headers of several rows, lost periods, and the unpivot to metrics. All JVM-side.

A table is (table_id, title, headers, rows) and perhaps a ``context``, the text of its page. ``shaped`` adds what the others read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import quoted
from .numbers import parse_cell, unit_of
from .periods import MONTHS, looks_like_period
from .text import clean_evidence, settled, statement_tag

#: Labels that name no metric, serial numbers, months, and where the header's part of a page begins and ends.
NOT_LABELS = r"(?i)^(note[s]?|continued|contd\.?|particulars|sr\.?\s*no\.?|s\.?\s*no\.?)$"
SERIAL = r"^\(?\d{1,3}\)?\.?$"
MONTH = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?|september|oct(ober)?|nov(ember)?|dec(ember)?)$"
HEADER_START = r"(?is)^.*?particulars"
HEADER_END = r"(?is)(\bassets\b|\bliabilities\b|\bincome\b|\bexpenses\b|\bcash\s+flow\b|\(a\)).*$"
FULL_DATE = r"([A-Za-z]{3,9})\s+(\d{1,2})\s*,\s*(\d{4})"
AS_AT = r"(?i)as\s+at\s+([A-Za-z]{3,9})\s*(\d{1,2})?\s*,?"
REST_OF_DATE = r"\b(?:(\d{1,2})\s*,\s*)?(\d{4})\b"
#: How many leading rows may belong to the header.
HEADER_ROWS = 20


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def clean_rows(rows: Column) -> Column:
    """Cells with single spaces, without blank rows."""
    tidy = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    return F.filter(tidy, lambda r: F.exists(r, lambda c: c != ""))


def is_label(text: Column) -> Column:
    flat = _flat(text)
    return F.length(flat).between(2, 150) & flat.rlike(r"\p{L}") & ~flat.rlike(NOT_LABELS)


def is_date_fragment(cell: Column) -> Column:
    """A bare day of a month or a bare year."""
    flat = _flat(cell)
    day = F.regexp_extract(flat, r"^\(?(\d{1,2})\)?$", 1).try_cast("int")
    return F.coalesce(day.between(1, 31), F.lit(False)) | flat.rlike(r"^\(?(19|20)\d{2}\)?$")


def looks_like_label(text: Column) -> Column:
    """The loose shape of a period: short, with a letter."""
    flat = _flat(text)
    return (flat != "") & (F.length(flat) <= 25) & flat.rlike(r"\p{L}")


def is_number(cell: Column) -> Column:
    return parse_cell(cell)["value"].isNotNull()


def header_rows(headers: Column, rows: Column, figures: Column, most: int = HEADER_ROWS) -> Column:
    """How many leading rows belong to the header: none where it is plain, else up to the first blank row or one with two figures.
    ``figures`` has, row by row, whether each cell is a number."""
    named = F.filter(headers, lambda h: _flat(h) != "")
    ambiguous = (F.size(F.array_distinct(named)) < F.size(named)) | (F.size(named) < F.size(headers))
    both = F.zip_with(F.slice(rows, 1, most), F.slice(figures, 1, most), lambda r, f: F.zip_with(r, f, lambda c, x: F.struct(_flat(c).alias("c"), x.alias("x"))))
    stops = lambda r: ~F.exists(r, lambda c: c["c"] != "") | (F.size(F.filter(r, lambda c: c["x"] & ~is_date_fragment(c["c"]))) >= 2)
    first = F.array_position(F.transform(both, stops), F.lit(True)).cast("int") - 1
    return F.when(~ambiguous, 0).when(first >= 0, first).otherwise(F.least(F.size(rows), F.lit(most)))


def merged_headers(headers: Column, top: Column) -> Column:
    """Headers and the rows ``top`` below them as one: the first row takes their place, later ones are added in brackets."""
    width = F.array_max(F.concat(F.array(F.size(headers)), F.transform(top, F.size)))
    at = lambda r, i: _flat(F.get(r, i))

    def column(i: Column) -> Column:
        start = F.coalesce(F.nullif(at(F.get(top, F.lit(0)), i), F.lit("")), at(headers, i))
        more = F.slice(top, 2, F.greatest(F.size(top) - 1, F.lit(0)))
        join = lambda h, r: F.when(at(r, i) == "", h).when((h != "") & (h != at(r, i)), F.concat(h, F.lit(" ("), at(r, i), F.lit(")"))).otherwise(at(r, i))
        return F.aggregate(more, start, join)

    return F.when(F.size(top) == 0, headers).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), column))


def label_column(headers: Column, rows: Column) -> Column:
    """1 where most of the first six rows begin with a serial number, else 0."""
    head = F.filter(F.slice(rows, 1, 6), lambda r: F.size(r) > 0)
    serial = F.size(F.filter(head, lambda r: _flat(F.get(r, F.lit(0))).rlike(SERIAL)))
    return F.when((F.size(headers) >= 3) & (F.size(head) > 0) & (serial >= 0.6 * F.size(head)), 1).otherwise(0)


# ------------------------------------------------------------------ periods


def header_window(context: Column, label: Column) -> Column:
    """The part of a page that may hold the header: behind 'Particulars', up to the first row's label or a word of the body."""
    text = F.regexp_replace(F.coalesce(context, F.lit("")), HEADER_START, "")
    core = _flat(F.regexp_replace(F.coalesce(label, F.lit("")), r"^\(?\w{1,3}\)?[.)]?\s*", ""))
    loose = F.concat(F.lit("(?is)^(.*?)"), F.regexp_replace(quoted(core), r"\s+", r"\\s*"))
    there = (F.length(core) >= 4) & F.regexp_like(text, loose)
    return F.when(there, F.call_function("regexp_extract", text, loose, F.lit(1))).otherwise(F.regexp_replace(text, HEADER_END, ""))


def _dates(months: Column, days: Column, years: Column, n: Column) -> Column:
    """'Mon d, yyyy' of the parts; null unless there are n distinct sound ones."""
    rows = F.arrays_zip(months.alias("m"), days.alias("d"), years.alias("y"))
    text = lambda r: F.when(r["m"].rlike(MONTH) & (r["d"] != "") & (r["y"] != ""), F.concat(F.initcap(F.substring(r["m"], 1, 3)), F.lit(" "), r["d"].try_cast("int").cast("string"), F.lit(", "), r["y"]))
    found = F.filter(F.transform(rows, text), lambda x: F.coalesce(looks_like_period(x), F.lit(False)))
    return F.when(F.size(F.array_distinct(found)) == n, found)


def recovered_periods(window: Column, n: Column) -> Column:
    """n period labels from the header's part of a page: whole dates, or 'As at month day,' with its years further on; else null."""
    found = lambda text, pattern, i: F.regexp_extract_all(text, F.lit(pattern), i)
    whole = F.when(F.size(found(window, FULL_DATE, 0)) == n, _dates(found(window, FULL_DATE, 1), found(window, FULL_DATE, 2), found(window, FULL_DATE, 3), n))
    tail = F.regexp_replace(window, r"(?is)^.*as\s+at\s+[A-Za-z]{3,9}\s*(\d{1,2})?\s*,?", "")
    months, days = found(window, AS_AT, 1), found(window, AS_AT, 2)
    late, years = F.slice(found(tail, REST_OF_DATE, 1), F.lit(1), n), F.slice(found(tail, REST_OF_DATE, 2), F.lit(1), n)
    split = F.when((F.size(months) == n) & (F.size(years) == n), _dates(months, F.zip_with(days, late, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)), years, n))
    return F.when((window != "") & (n >= 1), F.coalesce(whole, split))


def consistent_rows(counts: Column, n: Column) -> Column:
    """The commonest count of figures in a row (the larger on ties) nearly fills the columns, and four rows in five are near it."""
    tally = F.transform(F.array_distinct(counts), lambda v: F.struct(F.size(F.filter(counts, lambda x: x == v)).alias("k"), v.alias("v")))
    mode = F.array_max(tally)["v"]
    near = F.size(F.filter(counts, lambda x: F.abs(x - mode) <= 1))
    return (F.size(counts) > 0) & F.coalesce(mode >= F.greatest(F.lit(2), n - 2), F.lit(False)) & (near >= 0.8 * F.size(counts))


def shaped(tables: DataFrame, header_most: int = HEADER_ROWS) -> DataFrame:
    """Tables with ``heads`` and ``body`` parted, ``label_at``, ``value_at`` (columns of values), ``own``, ``found`` and ``periods``.

    ``periods`` is null where the columns cannot be told apart: several columns need distinct labels of a period's shape, if
    need be from the context (``found``); columns without any header are numbered where the rows are alike.
    """
    t = tables if "context" in tables.columns else tables.withColumn("context", F.lit(None).cast("string"))
    t = settled(t.withColumn("figures", F.transform("rows", lambda r: F.transform(r, is_number))))
    t = settled(t.withColumn("top", header_rows(F.col("headers"), F.col("rows"), F.col("figures"), header_most)))
    rest = lambda c: F.slice(c, F.col("top") + 1, F.greatest(F.size(c), F.lit(1)))
    t = settled(t.withColumns({"heads": merged_headers(F.col("headers"), F.slice("rows", F.lit(1), F.col("top"))), "body": rest("rows"), "figures": rest("figures")}).drop("top"))
    t = settled(t.withColumn("label_at", label_column(F.col("heads"), F.col("body"))))
    t = t.withColumn("value_at", F.expr("filter(transform(heads, (h, i) -> i), i -> i > label_at)"))
    t = settled(t.withColumn("labels", F.transform("body", lambda r: _flat(F.get(r, F.col("label_at"))))))
    t = t.withColumn("own", F.transform("value_at", lambda i: _flat(F.get(F.col("heads"), i))))
    counts = F.zip_with("labels", "figures", lambda x, f: F.when(x != "", F.size(F.filter("value_at", lambda i: F.coalesce(F.get(f, i), F.lit(False))))))
    t = t.withColumns({"counts": F.array_compact(counts), "window": header_window(F.col("context"), F.get(F.filter("labels", lambda x: x != ""), F.lit(0)))})
    t = settled(t)
    n = F.size("value_at")
    t = settled(t.withColumn("found", recovered_periods(F.col("window"), n)))
    numbered = F.when(consistent_rows(F.col("counts"), n), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    sound = (F.size(F.array_distinct("own")) == n) & F.forall("own", looks_like_period)
    single = F.transform("own", lambda h: F.when(looks_like_period(h), h).otherwise(""))
    several = F.when(F.forall("own", lambda h: h == ""), numbered).when(sound, F.col("own")).otherwise(F.col("found"))
    return settled(t.withColumn("periods", F.when((F.size("heads") >= 2) & (n == 1), single).when(n > 1, several)).drop("figures", "counts", "window"))


def unpivot(tables: DataFrame) -> DataFrame:
    """(table_id, row_no, name, value, unit, period): label times value columns; tables that cannot be read for sure give nothing."""
    t = shaped(tables).where("periods is not null").select("table_id", "title", "label_at", "value_at", "periods", F.posexplode("body").alias("row_no", "r"))
    t = t.withColumn("name", _flat(F.expr("get(r, label_at)"))).where(is_label(F.col("name")))
    c = t.select("table_id", "row_no", "name", "title", "periods", "r", F.posexplode("value_at").alias("k", "i"))
    c = c.withColumn("v", parse_cell(F.expr("get(r, i)"))).where("v.value is not null")
    return c.select("table_id", "row_no", "name", F.col("v.value").alias("value"), F.coalesce("v.unit", unit_of(F.coalesce("title", F.lit("")))).alias("unit"), F.expr("get(periods, k)").alias("period"))


# ------------------------------------------------------------------ texts


def table_text(title: Column, headers: Column, rows: Column) -> Column:
    """A table for embedding. More than two columns: a block per row of its label and 'header = value' lines; else 'header: value' pairs."""
    some = lambda a: F.filter(a, lambda x: F.coalesce(x, F.lit("")) != "")
    pair = lambda sep: lambda h, v: F.when(h.isNotNull() & (F.coalesce(v, F.lit("")) != ""), F.concat(h, F.lit(sep), v))
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1)))
    block = lambda r: F.array_join(F.array_compact(F.concat(F.array(F.nullif(F.get(r, F.lit(0)), F.lit(""))), F.zip_with(rest(headers), rest(r), pair(" = ")))), "\n")
    line = lambda r: F.array_join(F.array_compact(F.zip_with(headers, r, pair(": "))), "; ")
    wide = F.size(headers) > 2
    lines = some(F.transform(rows, lambda r: F.when(wide, block(r)).otherwise(line(r))))
    columns = F.when(F.size(headers) > 0, F.concat(F.lit("Columns: "), F.array_join(some(headers), ", ")))
    parts = F.concat(some(F.array(title, columns)), lines)
    return F.when(wide, F.array_join(parts, "\n\n")).otherwise(F.array_join(parts, "\n"))


def table_markdown(tables: DataFrame, most: int = 40, most_text: int = 1200) -> DataFrame:
    """(table_id, markdown): a table with its periods, or 'Col n' where a column has none, led by its statement type; a table
    without label, value or row falls back to its cleaned text. Reads title, section, document and text beside the table."""
    t = shaped(tables.withColumn("context", F.col("text")))
    t = settled(t.withColumn("names", F.when(F.forall("own", looks_like_period), F.col("own")).otherwise(F.coalesce("found", "own"))))
    heads = F.zip_with("names", "value_at", lambda h, i: F.when(looks_like_period(h), h).otherwise(F.concat(F.lit("Col "), (i + 1).cast("string"))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    shown = F.filter(F.slice("body", 1, most), lambda r: _flat(F.get(r, F.col("label_at"))) != "")
    body = F.transform(shown, lambda r: line(F.concat(F.array(_flat(F.get(r, F.col("label_at")))), F.transform("value_at", lambda i: _flat(F.get(r, i))))))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size("value_at") + 1), "|"), F.lit("|"))
    more = F.when(F.size("body") > most, F.concat(F.lit("\n(+"), (F.size("body") - most).cast("string"), F.lit(" more rows truncated)"))).otherwise("")
    tag = statement_tag(F.col("title"), F.col("section"), F.col("document"), F.col("text"))
    good = (F.size("headers") > 0) & (F.size("heads") >= 2) & (F.size("value_at") > 0) & (F.size(shown) > 0)
    text = F.concat(tag, F.array_join(F.concat(F.array(line(F.concat(F.array(F.lit("Metric")), heads)), rule), body), "\n"), more)
    return t.select("table_id", F.when(F.coalesce(good, F.lit(False)), text).otherwise(F.substring(clean_evidence(F.coalesce("text", F.lit(""))), 1, most_text)).alias("markdown"))
