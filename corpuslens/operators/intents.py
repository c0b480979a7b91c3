"""Intent of queries, their routing and retrieval plan, sub-queries, and the confidence in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

# Keywords and bonus of each intent in order of precedence, words that favour cases, domains and plan of each intent.
HIT = 0.22
RULES = (
    ("spec_lookup", "规范 标准 条文 要求 限值 允许偏差 验收 国标 行标 gb jgj jtg cjj 多少 不得低于 不应大于 规定".split(), 0.0),
    ("quality_diagnosis", "质量问题 缺陷 裂缝 渗漏 空鼓 蜂窝 麻面 露筋 沉降 变形 原因 成因 为什么会 事故 返工 不合格 处理办法 怎么处理 整改 通病".split(), 0.05),
    ("scheme_generation", "方案 工艺 流程 施工步骤 怎么施工 如何施工 编制 技术措施 交底 组织设计 专项方案".split(), 0.05),
    ("case_retrieval", "案例 类似工程 以前 历史 经验 教训 先例 参考项目 别的项目 踩坑".split(), 0.05),
    ("chitchat", "你好 你是谁 谢谢 再见 介绍一下你 会做什么 帮我干嘛".split(), 0.0),
)
CASE_WORDS = "参考 类似 可以 有哪些 举例 借鉴 经验 教训 之前 以前 历史 先例".split()
SAFETY_WORDS = "安全 坍塌 倾覆 危大 临边 高处 起重".split()
CHITCHAT_LENGTH = 14
# intent: domains, strategy, top_k, score threshold, weight of vectors, weight of BM25
PLANS = {
    "spec_lookup": (("standard", "enterprise"), "precision", 14, 0.10, 0.45, 0.55),
    "quality_diagnosis": (("case", "standard"), "recall", 28, 0.08, 0.6, 0.4),
    "scheme_generation": (("enterprise", "standard", "case"), "balanced", 22, 0.10, 0.55, 0.45),
    "case_retrieval": (("case", "enterprise"), "recall", 24, 0.09, 0.6, 0.4),
    "unknown": (("standard", "case", "enterprise"), "balanced", 20, 0.12, 0.6, 0.4),
    "chitchat": ((), "none", 0, 0.12, 0.6, 0.4),
}


def any_of(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def classified(queries: DataFrame, rules=RULES, query: str = "query") -> DataFrame:
    """Adds `intent` and `intent_confidence`. Ties go to the rule listed first; a null query is unknown."""
    text = T.text_or_empty(F.col(query))
    low = F.lower(text)

    def score(words: list[str], bonus: float) -> Column:
        hits = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
        return F.when(hits > 0, hits * F.lit(HIT) + F.lit(bonus))

    found = F.filter(F.array(*[F.struct(score(w, b).alias("s"), F.lit(-i).alias("at"), F.lit(n).alias("intent")) for i, (n, w, b) in enumerate(rules)]), lambda x: x["s"].isNotNull())
    long = F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) > CHITCHAT_LENGTH
    q = queries.withColumn("_found", found).withColumn("_best", F.array_max("_found"))
    rest = F.when((F.col("_best.intent") == "chitchat") & long, F.filter("_found", lambda x: x["intent"] != "chitchat")).otherwise(F.col("_found"))
    rival = F.coalesce(F.array_max(F.transform(F.filter("_found", lambda x: x["intent"] != "case_retrieval"), lambda x: x["s"])), F.lit(0.0))
    raised = lambda x: F.struct(F.when((x["intent"] == "case_retrieval") & (x["s"] <= F.col("_rival")), F.col("_rival") + 0.1).otherwise(x["s"]).alias("s"), x["at"].alias("at"), x["intent"].alias("intent"))
    q = q.withColumn("_found", rest).withColumn("_rival", rival)
    q = q.withColumn("_best", F.array_max(F.when(any_of(low, CASE_WORDS), F.transform("_found", raised)).otherwise(F.col("_found"))))
    sure = F.when(F.col("_best").isNotNull(), F.round(F.least(F.lit(0.95), 0.45 + F.col("_best.s")), 3)).otherwise(0.3)
    return q.withColumns({"intent": F.coalesce("_best.intent", F.lit("unknown")), "intent_confidence": sure}).drop("_found", "_best", "_rival")


def planned(queries: DataFrame, plans: dict = PLANS, explicit: str | None = None) -> DataFrame:
    """Adds domains (those of `explicit` where it has some), need_retrieval, strategy, top_k, threshold and weights of each row's intent."""
    schema = "intent string, domains array<string>, strategy string, top_k int, threshold double, vector_weight double, bm25_weight double"
    rows = queries.sparkSession.createDataFrame([(k, list(d), *rest) for k, (d, *rest) in plans.items()], schema)  # a row for each intent
    known = F.when(F.col("intent").isin(*plans), F.col("intent")).otherwise("unknown")
    out = queries.withColumn("intent", known).join(F.broadcast(rows), "intent").withColumn("need_retrieval", F.col("intent") != "chitchat")
    return out if explicit is None else out.withColumn("domains", F.when(F.size(explicit) > 0, F.col(explicit)).otherwise(F.col("domains")))


def sub_queries(queries: DataFrame, key: str = "query_id", query: str = "query", shortest: int = 6, most: int = 3) -> DataFrame:
    """(key, n, sub_query) of queries that ask several things: the first `most` parts of `shortest` characters or more."""
    parts = F.transform(F.split(T.text_or_empty(F.col(query)), "[?？;；]|以及|还有"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    q = queries.select(key, F.filter(parts, lambda s: F.length(s) >= shortest).alias("parts")).where(F.size("parts") > 1)
    return q.select(key, F.posexplode(F.slice("parts", 1, most)).alias("n", "sub_query")).withColumn("n", F.col("n") + 1)


def citations(contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """Contexts (query_id, rank, ...) that the answer (query_id, answer) marks; all of them if it marks none of them."""
    c = contexts.join(answers.select("query_id", T.citation_marks(F.col("answer")).alias("marks")), "query_id")
    marked = c.groupBy("query_id").agg(F.bool_or(F.array_contains("marks", F.col("rank"))).alias("some"))
    return c.join(marked, "query_id").where(~F.col("some") | F.array_contains("marks", F.col("rank"))).drop("marks", "some")


def confidence(contexts: DataFrame, answers: DataFrame, high: float = 0.75, low: float = 0.45) -> DataFrame:
    """(query_id, confidence, level, need_review) of answers (query_id, query, answer) from their contexts (query_id, doc_id, final_score, governance_status).

    An answer without context has confidence 0 and needs review, as has one whose query is about safety.
    """
    s = contexts.groupBy("query_id").agg(F.max("final_score").alias("top"), F.avg("final_score").alias("mean"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.bool_or(F.col("governance_status") == "deprecated").alias("old"))
    a = answers.join(s, "query_id", "left")
    q, t = F.array_distinct(T.tokenize(F.col("query"))), T.tokenize(F.col("answer"))
    one = lambda c: F.least(F.lit(1.0), c)
    cover = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    cited = F.size(T.citation_marks(F.col("answer"))) / F.greatest(F.lit(1), F.least(F.lit(3), F.col("n")))
    sure = 0.34 * one(0.6 * F.col("top") + 0.4 * F.col("mean")) + 0.14 * one(F.col("n") / 4) + 0.14 * one(F.col("docs") / 3) + 0.24 * one(cited) + 0.14 * cover
    sure = sure * F.when(F.col("old"), 0.75).otherwise(1.0) * F.when(F.col("answer").contains("未提供") | F.col("answer").contains("知识库未"), 0.6).otherwise(1.0)
    a = a.withColumn("confidence", F.when(F.col("n") > 0, F.round(one(sure), 4)).otherwise(0.0))
    level = F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= low, "medium").otherwise("low")
    return a.select("query_id", "confidence", level.alias("level"), ((F.col("confidence") < low) | any_of(T.text_or_empty(F.col("query")), SAFETY_WORDS)).alias("need_review"))


def gap_tasks(gaps: DataFrame, tasks: DataFrame | None = None, often: int = 3) -> DataFrame:
    """(query_key, task_type, priority) of gaps (query_key, n) that have no task yet."""
    new = gaps if tasks is None else gaps.join(tasks.select("query_key").distinct(), "query_key", "left_anti")
    return new.select("query_key", F.lit("gap_fill").alias("task_type"), F.when(F.col("n") >= often, "high").otherwise("medium").alias("priority"))
