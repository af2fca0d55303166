"""Downloads and uploads: which file is taken, what is there already, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scoring, urls


def first_valid_pdf(links: DataFrame, files: DataFrame, key: str = "company_id", order: str = "link_id", most: int = 3) -> DataFrame:
    """The first of each company's `most` best PDF links whose file holds. files: url and problem (null if there's none)."""
    score = scoring.pdf_link_score(F.col("url"), F.col("text"), F.col("ticker"))
    pdfs = links.filter(F.lower("url").contains(".pdf")).withColumn("score", score)
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    top = pdfs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    good = files.filter("problem is null").select("url").distinct()
    held = top.join(good, "url", "left_semi")
    return held.groupBy(key).agg(F.min(F.struct("place", order, "score")).alias("m")).select(key, f"m.{order}", "m.place", "m.score")


def to_download(wanted: DataFrame, present: DataFrame, name: str = "filename") -> DataFrame:
    """Reports whose file isn't there yet, or is unusable. present: the file's name and its problem (null if there's none)."""
    return wanted.join(present.filter("problem is null").select(name).distinct(), name, "left_anti")


def of_ticker(files: DataFrame, ticker: str | None) -> DataFrame:
    """Files of a ticker in any case; all of them if none is named."""
    return files if not ticker else files.filter(F.upper("ticker") == ticker.upper())


def sizes(size: Column) -> Column:
    """struct(kb, mb) of a size in bytes."""
    return F.struct(F.round(size / 1024, 1).alias("kb"), F.round(size / (1024 * 1024), 2).alias("mb"))


def summary(results: DataFrame, ok: str, files: DataFrame) -> DataFrame:
    """One row of a run over companies (ticker, and whether its download came): who succeeded and failed, in order, how many, and
    the number and size of report files (name, size) in the folder."""
    good = F.expr(ok)
    listed = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("ticker")))), ",")
    run = results.agg(
        listed(good).alias("successful"), listed(~good).alias("failed"), F.count_if(good).alias("total_success"),
        F.count_if(~good).alias("total_failed"),
    )
    reports = files.filter(F.col("name").rlike(r"\.(pdf|xlsx|xls)$"))
    folder = reports.agg(F.count("*").alias("n_files"), F.round(F.coalesce(F.sum(F.col("size").cast("double")), F.lit(0.0)) / (1024 * 1024), 2).alias("total_mb"))
    return run.join(folder)  # one row and one row


def uploads(files: DataFrame, root: str, period: Column, error: Column) -> DataFrame:
    """One row for each file that was to be stored: ticker, file, whether it was, and where or why not. No error stops the others."""
    name = F.col("filename")
    ticker = F.split_part(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(1))
    place = F.concat_ws("/", F.lit(root), F.lit("raw"), ticker, period, name)
    return files.select(
        ticker.alias("ticker"), name.alias("file"), error.isNull().alias("success"), F.when(error.isNull(), place).alias("path"), error.alias("error")
    )


def answer_problem(url: Column, content_type: Column, head: Column) -> Column:
    """Why an answer is not taken for a report, or null: it calls itself a web page, or begins like one."""
    return F.when(rules.page_by_type(content_type), "web page by its type").when(rules.web_page_instead(url, head), "web page by its start")


def state_backup(path: Column, suffix: Column) -> Column:
    """Where a copy of a state goes."""
    return F.replace(path, F.lit(".json"), F.concat(F.lit("_backup_"), suffix, F.lit(".json")))


def report_name(ticker: Column, year: Column, url: Column) -> Column:
    return urls.report_filename(ticker, year, url)
