"""Sheets as tables of exact text: CSV files with a header, and what questions and sections they hold."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import labels, text
from tessera.operators import rules

CELLS = "sheet string, row_number long, header string, value string, error string"
#: Sheets that hold no questions.
SKIPPED = ("readme", "bank_index", "quiz_structure")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row_number (the header is 1), header, value, error: each cell that is not empty, with its text as it is.

    A sheet with a blank or repeated header, and a cell that holds a formula, give a row with error.  Each file is
    read by one task, line by line as the CSV rules have it (quoted cells may hold line breaks)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "content")

    def cells(frames):
        for frame in frames:
            for p, content in zip(frame.path, frame.content, strict=True):
                sheet = p.rpartition("/")[2].rpartition(".")[0]
                lines = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                headers = [h.strip() for h in next(lines, [])]
                wrong = "blank_header" if not headers or "" in headers else "duplicate_header" if len(set(headers)) < len(headers) else None
                rows = [(sheet, 1, None, None, wrong)] if wrong else [(sheet, n, h, v, "formula" if v.startswith("=") else None) for n, line in enumerate(lines, 2) for h, v in zip(headers, line, strict=False) if v != ""]
                yield pd.DataFrame(rows, columns=["sheet", "row_number", "header", "value", "error"]).astype({"row_number": "int64"})

    return found.mapInPandas(cells, CELLS)


def missing_headers(cells: DataFrame, required: list[str]) -> DataFrame:
    """sheet, header of required headers under which a sheet has nothing."""
    sheets = cells.select("sheet").distinct().withColumn("header", F.explode(F.array(*map(F.lit, required))))
    return sheets.join(cells.select("sheet", "header").distinct(), ["sheet", "header"], "left_anti")


def rows(cells: DataFrame) -> DataFrame:
    """sheet, row_number, cells: one map of normalised headers to trimmed values for each row; of equal headers the last cell wins."""
    named = cells.filter("error IS NULL").select("sheet", "row_number", labels.header(F.col("header")).alias("h"), F.trim("value").alias("v")).filter("h <> ''")
    once = named.groupBy("sheet", "row_number", "h").agg(F.max("v").alias("v"))
    return once.groupBy("sheet", "row_number").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("cells"))


def questions(sheet_rows: DataFrame) -> DataFrame:
    """Questions of all sheets that hold them: code, bank, kind, text, points, options and key, each in its own column."""
    c = F.col("cells")

    def cell(name: str, otherwise=""):
        return F.coalesce(F.nullif(c[name], F.lit("")), otherwise if not isinstance(otherwise, str) else F.lit(otherwise))

    held = sheet_rows.filter(~F.lower("sheet").isin(*SKIPPED)).filter(cell("question_code") != "")
    bank = cell("bank_id", F.col("sheet"))
    options = F.array(*[cell(f"option_{x}") for x in "abcde"])
    kind = F.upper(F.regexp_replace(cell("target_question_type"), "[^A-Za-z]", ""))
    bare = held.select(
        "sheet", "row_number", cell("question_code").alias("question_code"), bank.alias("bank_id"), cell("bank_title", bank).alias("bank_title"), kind.alias("kind"), F.upper(cell("scoring_policy")).alias("scoring_policy"),
        cell("question_text").alias("question_text"), F.expr("try_cast(coalesce(nullif(cells['points'], ''), '1') AS double)").alias("points"), text.truthy(c["randomize_answers"]).alias("randomize"),
        F.when(kind == "TRUEFALSE", F.array(F.lit("True"), F.lit("False"))).otherwise(F.filter(options, lambda x: x != "")).alias("options"), F.concat(F.lit("QUES_"), labels.safe_ident(c["question_code"], "Q")).alias("label"),
        labels.answer_letters(kind, c["correct_option_key"], c["correct_option_text"], options).alias("answer_keys"),
    )
    return bare


def sections(sheet_rows: DataFrame, held: DataFrame) -> DataFrame:
    """Sections of the structure sheet, or one for each bank where there is none: order, title, bank, draws, points, available."""
    c = F.col("cells")
    given = sheet_rows.filter(F.lower("sheet") == "quiz_structure").filter(F.coalesce(c["source_bank_id"], F.lit("")) != "")
    number = F.row_number().over(Window.partitionBy("sheet").orderBy("row_number"))
    told = given.select(
        F.coalesce(F.expr("try_cast(cells['section_order'] AS int)"), number).alias("section_order"), F.coalesce(F.nullif(c["section_title"], F.lit("")), c["source_bank_id"]).alias("section_title"), c["source_bank_id"].alias("bank_id"),
        F.coalesce(F.expr("try_cast(cells['recommended_draw_count'] AS int)"), F.lit(1)).alias("draws"), F.coalesce(F.expr("try_cast(cells['points_per_question'] AS double)"), F.lit(1.0)).alias("points"),
    )
    banks = held.groupBy("bank_id").agg(F.count("*").alias("available"), F.min(F.struct("sheet", "row_number", "bank_title", "points")).alias("f"))
    made = banks.select(F.row_number().over(Window.orderBy("f.sheet", "f.row_number")).alias("section_order"), F.col("f.bank_title").alias("section_title"), "bank_id", F.col("available").cast("int").alias("draws"), F.col("f.points").alias("points"))
    none = told.limit(1).groupBy().agg(F.count("*").alias("n")).filter("n = 0")
    out = told.unionByName(made.join(F.broadcast(none.select("n")), F.col("n") == 0, "left_semi"))
    return out.join(banks.select("bank_id", "available"), "bank_id", "left").fillna(0, ["available"])


def intake_issues(held: DataFrame, drawn: DataFrame) -> DataFrame:
    """What stops an intake: repeated codes, policies that several choices cannot have, numbers that are none, sections that draw from too little."""
    policy = (F.col("kind") != "MULTISELECT") | F.col("scoring_policy").isin("", "ALL_OR_NOTHING")
    return rules.union_all([
        rules.repeated(held, ["question_code"], "duplicate_code"),
        rules.violating(held, "question_code", policy, "scoring_policy", F.col("scoring_policy"), "error"),
        rules.violating(held, "question_code", F.col("points").isNotNull(), "points", F.col("points"), "error"),
        rules.violating(drawn, "section_title", F.col("available") > 0, "empty_bank", F.col("bank_id"), "error"),
        rules.violating(drawn, "section_title", (F.col("available") == 0) | (F.col("draws") <= F.col("available")), "draws_too_many", F.concat_ws("/", "draws", "available"), "error"),
    ])
