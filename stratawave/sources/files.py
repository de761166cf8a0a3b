"""Readers and writers: wide CSV series, JSON lines with their aliases and byte order marks, id lists, score trees, reports, resuming sinks."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import safe_double

#: Names under which an id, a task and an answer may come.
ID_NAMES = ("id", "rid", "qid", "sample_id", "uid", "example_id", "question_id")
TASK_NAMES = ("task_name", "task", "taskName")
ANSWER_NAMES = ("answer_parsed", "answer", "pred")


#: Bytes of headers up to which the table of files and headers is broadcast; beyond them rows are joined to it by exchange.
HEADER_BYTES = 32 << 20
_ROOT = "^([^:/]+):/+"
STATICS = ("rmse_mm", "mean_velocity_std", "seasonality_std")


def first_line(spark: SparkSession, path: str) -> str:
    """First line of a file that Spark can read, uncompressed if its ending says so, without a byte order mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    place = hadoop.fs.Path(jvm.java.net.URI(path))
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        text = hadoop.io.Text()
        hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream).readLine(text)
        return text.toString().removeprefix("\ufeff")
    finally:
        stream.close()


def layout_of(path: str, header: str) -> tuple:
    """Where a wide file keeps what: places of pid, easting, northing and the statics (None: nowhere), and (date, place) of each epoch in header order."""
    at = {}
    for i, name in enumerate(next(csv.reader([header]), [])):
        at.setdefault(name, i)
    dates = tuple((name, i) for name, i in at.items() if re.fullmatch(r"\d{8}", name))
    if "pid" not in at or not dates:
        raise ValueError(f"{path}: wide series need a pid column and date columns")
    if int(0.8 * len(dates)) < 2:
        raise ValueError(f"{path}: {len(dates)} epochs leave too few to train on")
    return at["pid"], at.get("easting"), at.get("northing"), at.get("rmse_mm", at.get("rmse")), at.get("mean_velocity_std"), at.get("seasonality_std"), dates


def read_wide_csv(spark: SparkSession, path: str, pattern: str | None = None, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """Wide files (pid, statics, one YYYYMMDD column per epoch) as long rows: tile, pid, easting, northing, the STATICS, d, epoch, total, y.

    Each file follows its own header, which may hold other dates in another
    order: epochs count along it, total is how many there are. The tile is the E..N.. part
    of the file name, or the name. Values that are no finite number are
    null, statics 0; a short row's last values are null, a column's later namesakes are ignored. rmse
    stands in where there is no rmse_mm column. No file, a file without pid or dates, or with fewer than 3 epochs, raises.

    The driver reads the first line of every file, some at a time, and keeps each
    distinct header once; one scan by position reads all files, however many headers there are.
    """
    given = (lambda r: r.option("pathGlobFilter", pattern)) if pattern else (lambda r: r)
    found = sorted(given(spark.read).text(path).inputFiles())
    if not found:
        raise ValueError(f"no files match {path} {pattern or ''}")
    with ThreadPoolExecutor(32) as pool:
        headers = list(pool.map(lambda f: first_line(spark, f), found))
    known = {h: layout_of(f, h) for f, h in zip(reversed(found), reversed(headers), strict=True)}
    number = {h: i for i, h in enumerate(known)}
    width = 1 + max(max(i for i in (*own[:-1], own[-1][-1][1], *(i for _, i in own[-1])) if i is not None) for own in known.values())
    cells = given(spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", True)).csv(path)
    cells = cells.select(F.array(*cells.columns).alias("cells"), F.regexp_replace("_metadata.file_path", _ROOT, "$1:/").alias("_file"), F.col("_metadata.file_name").alias("_name"))

    places = "layout int, pid int, easting int, northing int, rmse_mm int, mean_velocity_std int, seasonality_std int, dates array<struct<d: string, at: int>>"
    layouts = spark.createDataFrame([(number[h], *own[:-1], [*own[-1]]) for h, own in known.items()], places)
    files = spark.createDataFrame([(re.sub(_ROOT, r"\1:/", f), number[h]) for f, h in zip(found, headers, strict=True)], "_file string, layout int")
    size = sum(map(len, known)) + sum(map(len, found))
    hinted = F.broadcast if size <= header_bytes else (lambda df: df.hint("merge"))
    rows = cells.join(hinted(files), "_file").join(hinted(layouts), "layout")

    cell = lambda at: F.get("cells", at)
    number_at = lambda name: safe_double(cell(F.col(name)))
    tile = F.regexp_extract("_name", r"(E\d+N\d+)", 1)
    values = F.transform("dates", lambda t, i: F.struct(F.to_date(t["d"], "yyyyMMdd").alias("d"), i.alias("epoch"), safe_double(cell(t["at"])).alias("y")))
    return rows.select(
        F.when(tile != "", tile).otherwise(F.col("_name")).alias("tile"), cell(F.col("pid")).alias("pid"), number_at("easting").cast("long").alias("easting"), number_at("northing").cast("long").alias("northing"),
        *[F.coalesce(number_at(s), F.lit(0.0)).alias(s) for s in STATICS], F.size("dates").alias("total"), F.inline(values),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, a byte order mark at a file's start is dropped, broken lines give nulls."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """id, task_name, answer_parsed, parse_error, use_alt from JSON lines under any of their names, with _seq by line order within the read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.monotonically_increasing_id().alias("_seq")).where(F.trim("value") != "")
    first = lambda names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    return lines.select(first(ID_NAMES).alias("id"), first(TASK_NAMES).alias("task_name"), first(ANSWER_NAMES).alias("answer_parsed"), F.get_json_object("value", "$.parse_error").alias("parse_error"), (F.get_json_object("value", "$.use_alt") == "true").alias("use_alt"), "_seq")


def unwrap_pool(lines: DataFrame) -> DataFrame:
    """value: the inner object of {"dataset": {...}} lines that have a context or question, other lines as they are."""
    inner = F.get_json_object("value", "$.dataset")
    holds = F.get_json_object(inner, "$.context").isNotNull() | F.get_json_object(inner, "$.question").isNotNull()
    return lines.select(F.when(F.coalesce(holds, F.lit(False)), inner).otherwise(F.col("value")).alias("value"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a list: lines that are JSON strings, objects with an id, or plain text; or one JSON document with a list."""
    if path.endswith(".json"):
        whole = spark.read.option("wholetext", True).text(path)
        lists = F.coalesce(*[F.from_json(F.get_json_object("value", q), "array<string>") for q in ("$", "$.ids", "$.restrict_ids", "$.id_list", "$.qid_list")])
        return whole.select(F.explode(lists).alias("id")).where("id is not null").distinct()
    t = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    named = F.coalesce(*[F.get_json_object(t, f"$.{n}") for n in ID_NAMES])
    plain = F.regexp_replace(t, '^"|"$', "")
    return spark.read.text(path).select(F.when(t.startswith("{"), named).otherwise(plain).alias("id")).where("id is not null and id <> ''").distinct()


def ids_of(spark: SparkSession, argument: str) -> DataFrame:
    """Ids of a path to a list, or of a comma-separated text."""
    if re.search(r"\.(jsonl|json|txt|list)$", argument):
        return read_ids(spark, argument)
    return spark.createDataFrame([(x.strip(),) for x in argument.split(",") if x.strip()], "id string").distinct()


def restrict(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_semi")


def restricted_json_lines(spark: SparkSession, path: str, schema: str, ids: DataFrame) -> DataFrame:
    """read_json_lines of the lines whose id, under any of its names, is among ids; a line is parsed whole only once that is known.

    The id is cut out of the line for the semi-join, which stands below the parser in the plan, so lines of other ids cost no more
    than that. Lines without an id are left out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    named = lines.withColumn("_id", F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in ID_NAMES])).where("_id is not null")
    wanted = ids.select(F.col("id").cast("string").alias("_id")).distinct()
    return named.join(wanted, "_id", "left_semi").select(F.from_json("value", schema).alias("r")).select("r.*")


def require(df: DataFrame, needed: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """df with null columns for optional ones it lacks; lacking a needed one raises."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: F.lit(None).cast("string") for c in optional if c not in df.columns})


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def small(df: DataFrame) -> DataFrame:
    """df, if it has no more than REPORT_ROWS rows."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return df


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; over REPORT_ROWS rows raise."""
    small(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str, **more: object) -> None:
    """The one row of df as one JSON object in one file at path, with more fields in front (a scorer's version, say); any other number of rows raises."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    text = json.dumps({**more, **rows[0].asDict(recursive=True)}, ensure_ascii=False, indent=2, default=str)
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def append_missing(rows: DataFrame, path: str, key: str = "id") -> int:
    """Append to the JSON lines at path the rows whose key it lacks; returns how many."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    new = rows.join(spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias(key)), key, "left_anti") if there else rows
    seen = Observation()
    write_json_lines(new.observe(seen, F.count("*").alias("n")), path, append=True)
    return seen.get["n"]


def ensure_stage(df_of, path: str, spark: SparkSession) -> DataFrame:
    """The table at path if a complete write left its marker there, else what df_of() gives, written first."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def system_paths(items: Sequence[str]) -> dict[str, str]:
    """label=path arguments as a mapping."""
    out = {}
    for item in items:
        label, sep, path = item.partition("=")
        if not sep or not label.strip() or not path.strip():
            raise ValueError(f"expected label=path, got {item!r}")
        out[label.strip()] = path.strip()
    return out


def with_sequence(df: DataFrame, order: str) -> DataFrame:
    """Adds _seq, the rank by order within an id, for operators where the last row wins."""
    return df.withColumn("_seq", F.row_number().over(Window.partitionBy("id").orderBy(order)))


def read_item_scores(spark: SparkSession, path: str) -> DataFrame:
    """task_name, id, ok from item-score CSVs (id, task_name, correct): correct is cut to a whole number, so 1.0 is 1."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("task_name", "id", F.col("correct").try_cast("double").cast("int").alias("ok"))


def read_score_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """root/<model>/<variant>/{summary.json, by_task.csv, by_task_bucket.csv} as three tables.

    (model, variant, micro, macro), (model, variant, task_name, acc) and
    (model, variant, task_name, bucket_label, acc). Variants without a summary are
    left out of all three, rows without an accuracy or a name of the latter two.
    """
    place = F.split(F.col("_metadata.file_path"), "/")
    names = [F.element_at(place, -3).alias("model"), F.element_at(place, -2).alias("variant")]
    whole = spark.read.text(f"{root}/*/*/summary.json", wholetext=True).select(*names, F.from_json("value", "micro_acc double, macro_acc_over_tasks double").alias("s"))
    summary = whole.select("model", "variant", F.col("s.micro_acc").alias("micro"), F.col("s.macro_acc_over_tasks").alias("macro"))

    def rows(name, keys):
        csv = spark.read.option("header", True).csv(f"{root}/*/*/{name}").select(*names, *keys, F.col("acc").try_cast("double").alias("acc"))
        filled = F.col("acc").isNotNull()
        for k in keys:
            filled &= F.col(k).isNotNull() & (F.col(k) != "")
        return csv.where(filled).join(summary.select("model", "variant"), ["model", "variant"], "left_semi")

    return summary, rows("by_task.csv", ["task_name"]), rows("by_task_bucket.csv", ["task_name", "bucket_label"])


def percent(x: float | None, digits: int = 1) -> str:
    """A share as percent, -- for none."""
    return "--" if x is None else f"{x * 100:.{digits}f}"


def percent_change(a: float | None, b: float | None, digits: int = 1) -> str:
    """a - b in percent points with its sign, -- if either is none."""
    return "--" if a is None or b is None else f"{(a - b) * 100:+.{digits}f}"


#: Rows that go into a report or a table at most; more is no report.
REPORT_ROWS = 100_000


def interval_table(df: DataFrame, caption: str, metric: str = "macro") -> str:
    """LaTeX table of slices.intervals' rows of a metric: mean and bounds in percent points, by name."""
    shown = lambda c: F.format_string("%.2f", F.col(c) * 100)
    rows = df.where(F.col("metric") == metric).orderBy("name").select("name", F.concat(shown("mean"), F.lit(" ["), shown("low"), F.lit(", "), shown("high"), F.lit("]")).alias(f"delta {metric}"))
    return latex_table(rows, caption)


def method_table(rows: DataFrame, caption: str, label: str, methods: Sequence[str]) -> str:
    """LaTeX table of a method column and shares, in the order of methods; shares in percent, -- for none."""
    place = F.array_position(F.array(*map(F.lit, methods)), F.col(label))
    shares = [c for c in rows.columns if c != label and dict(rows.dtypes)[c] in ("double", "float")]
    kept = small(rows.where(place > 0)).orderBy(place)
    return latex_table(kept.select(label, *[F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c) * 100)).otherwise("--").alias(c) for c in shares]), caption)


def latex_table(df: DataFrame, caption: str, digits: int = 3) -> str:
    """A small result table as LaTeX; numbers rounded, special characters escaped. Over REPORT_ROWS rows raise."""
    mark = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else "".join(mark.get(c, c) for c in str(v))
    rows = [" & ".join(map(cell, df.columns)), *(" & ".join(map(cell, r)) for r in small(df).collect())]
    body = " \\\\\n".join(rows)
    return f"\\begin{{table}}\n\\caption{{{cell(caption)}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"
