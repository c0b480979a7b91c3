"""Pages of lists, trends of runs, query-log rows and reports for each knowledge base."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.governance import health_issues
from corpuslens.operators.quality import penalty
from corpuslens.sources.sliced import written


@dataclass(frozen=True)
class Pages:
    """Rows in a total order, dealt by ranges of it and stored once: a page sorts the one or two ranges in which it lies."""

    rows: DataFrame
    order: list[Column]
    sizes: list[tuple[int, int]]  # range, rows

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, page: int = 1, size: int = 20) -> DataFrame:
        """Rows of a page with total and pages; one past the end has no rows."""
        if page < 1 or size < 1:
            raise ValueError("page and size start at 1")
        start, before, held, skip = (page - 1) * size, 0, [], 0
        for part, n in self.sizes:
            if before < start + size and before + n > start:
                skip = skip if held else start - before
                held.append(part)
            before += n
        found = self.rows.where(F.col("_range").isin(held) if held else F.lit(False)).drop("_range").orderBy(*self.order).offset(max(skip, 0)).limit(size)
        return found.withColumns({"total": F.lit(self.total).cast("long"), "pages": F.lit(-(-self.total // size)).cast("long")})


def paged(rows: DataFrame, order: list[Column], ranges: int | None = None) -> Pages:
    """Deal rows by ranges of a total order and store them, for any number of pages."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "pages")
    return Pages(dealt, order, sorted(map(tuple, dealt.groupBy("_range").count().collect())))  # a row for each range


def page_of(rows: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of rows with total and pages, by a total order; a page past the end has no rows."""
    return paged(rows, order).page(page, size)


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], last: tuple | None = None, size: int = 20) -> DataFrame:
    """The `size` rows that follow the row with the values `last` of the sort keys (name, descending), which are a total order without
    nulls; from the start where that is None. Each task keeps its best `size` rows only, on however late a page."""
    if last is not None:
        later, same = F.lit(False), F.lit(True)
        for (name, falling), v in zip(keys, last, strict=True):
            later = later | (same & ((F.col(name) < F.lit(v)) if falling else (F.col(name) > F.lit(v))))
            same = same & (F.col(name) == F.lit(v))
        rows = rows.where(later)
    return rows.orderBy(*[F.desc(n) if falling else F.asc(n) for n, falling in keys]).limit(size)


def search_documents(docs: DataFrame, keyword: str = "", **equal: str) -> DataFrame:
    """Documents that are not deleted, with these values, whose title or standard code, where there is one, has the keyword in any
    case. A null title or code holds none."""
    out = docs.where(~F.col("is_deleted"))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    over = [c for c in ("title", "standard_code") if c in docs.columns]
    has = lambda c: F.contains(F.lower(T.text_or_empty(F.col(c))), F.lit(keyword.lower()))
    return out.where(F.exists(F.array(*map(has, over)), lambda x: x)) if keyword else out


def log_rows(answers: DataFrame, floor: float = 0.45) -> DataFrame:
    """Adds `answered` and `is_gap` to answers (intent, hit_count, confidence, rejected): a gap is a question, no chitchat,
    that found nothing, was rejected by the relevance floor, or has a confidence under `floor`. Nulls count as 0 and false."""
    hits, sure = F.coalesce("hit_count", F.lit(0)), F.coalesce("confidence", F.lit(0.0))
    weak = (hits == 0) | (sure < floor) | F.coalesce("rejected", F.lit(False))
    return answers.withColumn("answered", (hits > 0) & (sure > 0)).withColumn("is_gap", ~F.coalesce(F.col("intent") == "chitchat", F.lit(False)) & weak)


def trend(runs: DataFrame, metric: str, at: str, baseline: float, last: int = 10, slack: float = 0.02) -> DataFrame:
    """One row over the latest runs: first and latest value, their difference, and how many fell below or rose above the
    baseline by more than `slack`. Runs without the metric are left out; `at` is distinct."""
    r = runs.where(F.col(metric).isNotNull()).orderBy(F.desc(at)).limit(last)
    delta = F.round(F.col(metric) - baseline, 4)
    first, latest = F.min_by(metric, at), F.max_by(metric, at)
    return r.agg(
        F.count("*").alias("n_runs"), first.alias("first_value"), latest.alias("latest_value"), F.round(latest - first, 4).alias("delta"),
        F.count_if(delta < -slack).alias("n_regressed"), F.count_if(delta > slack).alias("n_improved"),
    )


def kb_reports(docs: DataFrame, as_of: Column) -> DataFrame:
    """Documents, issues, high issues and health score of each knowledge base with a live document; issues count where
    their document is. Ids are distinct."""
    live = docs.where(~F.col("is_deleted"))
    issues = health_issues(docs, as_of).join(live.select("doc_id", "kb_id"), "doc_id").groupBy("kb_id")
    issues = issues.agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "high").alias("n_high"), penalty().alias("penalty"))
    of = lambda c: F.coalesce(c, F.lit(0))
    score = F.round(F.greatest(F.lit(0.0), 100.0 - of("penalty") / F.col("n_docs") * 12.0), 1)
    n = live.groupBy("kb_id").agg(F.count("*").alias("n_docs"))
    return n.join(issues, "kb_id", "left").select("kb_id", "n_docs", of("n_issues").alias("n_issues"), of("n_high").alias("n_high"), score.alias("score"))


def alert_tasks(alerts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(alert_id, task_id): tasks made from the alert or from its report; two equality joins in place of one with OR."""
    a, t = alerts.select("alert_id", "report_id"), tasks.select("task_id", "source_alert_id", "source_report_id")
    own = a.join(t, F.col("alert_id") == F.col("source_alert_id")).select("alert_id", "task_id")
    return own.unionByName(a.join(t, F.col("report_id") == F.col("source_report_id")).select("alert_id", "task_id")).distinct()
