"""From ranked candidates to context blocks, extractive answers, search rows and explanations, for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.search import top
from corpuslens.sources.sliced import fetched, written

# Synonyms, pronouns, pattern of a number with its unit, and the texts around an answer.
SYNONYMS = {
    "养护": "保湿 浇水 覆盖 洒水养护", "拆模": "模板拆除 拆除模板", "强度": "抗压强度 试块强度 同条件试块", "保护层": "钢筋保护层 保护层厚度",
    "配合比": "混凝土配合比 设计配合比", "基坑": "深基坑 基坑支护 土方开挖", "验收": "检验批 验收标准 质量验收", "裂缝": "开裂 龟裂 裂纹",
    "渗漏": "漏水 渗水 防水失效", "焊缝": "焊接质量 焊缝探伤 无损检测", "沉降": "沉降观测 不均匀沉降 变形监测", "脚手架": "外脚手架 落地式脚手架 悬挑脚手架",
}
PRONOUNS = "它|该|这个|上面|刚才|前面|此"
MEASURE = r"\d+\s*(?:d|天|mm|MPa|N/mm|m³|%|kg|℃)"
NO_CONTEXT = "当前知识库未提供相关依据，无法给出可靠结论。建议补充相关规范或案例文档后重试，或联系对应专业负责人确认。"
ANSWER_HEAD = "**结论与依据**\n"
ANSWER_NOTE = "\n**说明**：以上内容直接摘自知识库检索到的工程资料，未作推断性扩展。如需结合具体工程条件形成实施方案，请由项目技术负责人复核后执行。"


def rewritten(queries: DataFrame, synonyms: dict[str, str] | None = None, pronouns: str = PRONOUNS) -> DataFrame:
    """Adds `rewritten` to queries (query, project_type, region, last_user): the query, synonyms of the terms it holds (80
    characters at most), the project's context, and where it refers back six keywords of the last user turn. Nulls add nothing."""
    q = F.trim(T.text_or_empty(F.col("query")))
    pairs = [F.when(q.contains(k), F.split(F.lit(v), " ")).otherwise(F.array().cast("array<string>")) for k, v in (SYNONYMS if synonyms is None else synonyms).items()]
    more = F.substring(F.array_join(F.array_distinct(F.flatten(F.array(*pairs))), " "), 1, 80)
    context = F.array_join(F.filter(F.array(T.text_or_empty(F.col("project_type")), T.text_or_empty(F.col("region"))), lambda x: x != ""), " ")
    back = F.when(q.rlike(pronouns), F.array_join(T.top_keywords(F.col("last_user"), 6), " ")).otherwise("")
    return queries.withColumn("rewritten", F.array_join(F.filter(F.array(q, more, context, back), lambda x: x != ""), " "))


def in_context(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests (conv_id, project_name, project_type, discipline, region, kb_ids) with what they leave open taken from their
    conversation; the discipline `general` is open as well. Conversations are distinct; a request without one stays as it is."""
    c = conversations.select("conv_id", *[F.col(x).alias(f"_{x}") for x in ("project_name", "project_type", "discipline", "region", "kb_ids")])
    r = requests.join(c, "conv_id", "left")
    mine = {x: F.coalesce(F.nullif(F.col(x), F.lit("")), F.col(f"_{x}"), F.lit("")) for x in ("project_name", "project_type", "region")}
    mine["discipline"] = F.coalesce(F.nullif(F.nullif(F.col("discipline"), F.lit("general")), F.lit("")), F.nullif(F.col("_discipline"), F.lit("")), F.lit("general"))
    mine["kb_ids"] = F.when(F.coalesce(F.size("kb_ids"), F.lit(0)) > 0, F.col("kb_ids")).otherwise(F.coalesce("_kb_ids", F.array().cast("array<string>")))
    return r.withColumns(mine).select(*requests.columns)


def with_sub_queries(found: DataFrame, extra: DataFrame, k: int = 20, weight: float = 0.9) -> DataFrame:
    """Candidates (query_id, doc_id, fusion_score) and those only sub-queries (with `n`) found, the first's score lowered, ranked anew."""
    late = extra.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").groupBy("query_id", "doc_id").agg(F.min_by("fusion_score", "n").alias("fusion_score"))
    both = found.select("query_id", "doc_id", "fusion_score").unionByName(late.withColumn("fusion_score", F.round(F.col("fusion_score") * weight, 6)))
    return top(both, "query_id", "fusion_score", "doc_id", k)


def boost_codes(found: DataFrame, codes: DataFrame, factor: float = 1.35) -> DataFrame:
    """Raises candidates (query_id, doc_id, standard_code, fusion_score) whose code begins like one of the query's `codes`, and ranks anew."""
    own = F.upper(F.regexp_replace(T.text_or_empty(F.col("standard_code")), " ", ""))
    hit = F.coalesce(F.exists("codes", lambda x: own.startswith(F.substring(F.upper(x), 1, 9))), F.lit(False)) & (own != "")
    c = found.drop("rank").join(codes.select("query_id", "codes"), "query_id", "left")
    c = c.withColumn("fusion_score", F.when(hit, F.round(F.col("fusion_score") * factor, 6)).otherwise(F.col("fusion_score"))).drop("codes")
    return top(c, "query_id", "fusion_score", "doc_id", 1 << 30)


def _head() -> Column:
    def part(before: str, c: str, after: str = "") -> Column:
        x = T.text_or_empty(F.col(c).cast("string"))
        return F.when((x == "") | (x == "0"), "").otherwise(F.concat(F.lit(before), x, F.lit(after)))

    state = F.when(F.col("governance_status") == "deprecated", " | ⚠已废弃，仅供参考").when(F.col("governance_status") == "need_update", " | ⚠待更新").otherwise("")
    return F.concat(F.lit("《"), F.coalesce("title", F.lit("未知文档")), F.lit("》"), part("（", "standard_code", "）"), part(" | 章节：", "section_path"), part(" | 条文：", "clause_no"), part(" | 第", "page_no", "页"), state)


def context_blocks(ranked: DataFrame, budget: int = 8000, least: int = 300, stop: int = 200) -> DataFrame:
    """(query_id, index_no, doc_id, rank, block) of ranked rows (query_id, doc_id, rank, content, title, standard_code, section_path,
    clause_no, page_no, governance_status): the first of those with one beginning and about one length, numbered, cut to the budget.

    Rows without text are left out. A block that does not fit is cut, or ends the list where less than `least` is left. The
    rows of a query are those a reranker keeps, so the fold over them is short.
    """
    body = F.regexp_replace(T.text_or_empty(F.col("content")), r"^\s+|\s+$", "")
    r = ranked.select("query_id", "doc_id", "rank", _head().alias("head"), body.alias("body")).where("body <> ''")
    same = W.partitionBy("query_id", F.substring("body", 1, 80), F.floor(F.length("body") / 50)).orderBy("rank", "doc_id")
    r = r.withColumn("r", F.row_number().over(same)).where("r = 1")
    rows = r.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "head", "body"))).alias("rows"))
    kind = r.schema["doc_id"].dataType.simpleString()
    out_type = f"array<struct<index_no:int,doc_id:{kind},rank:{r.schema['rank'].dataType.simpleString()},block:string>>"
    zero = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("done"), F.array().cast(out_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["out"]) + 1
        whole = F.concat(F.lit("["), n.cast("string"), F.lit("] "), x["head"], F.lit("\n"), x["body"])
        long = F.length(whole) > a["left"]
        done = a["done"] | (long & (a["left"] < least))
        block = F.when(long, F.concat(F.substring(whole, F.lit(1), a["left"]), F.lit("…"))).otherwise(whole)
        left = F.when(done, a["left"]).otherwise(a["left"] - F.length(block))
        row = F.struct(n.alias("index_no"), x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), block.alias("block"))
        return F.struct(left.alias("left"), (done | (left <= stop)).alias("done"), F.when(done, a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    return rows.select("query_id", F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("b")).select("query_id", "b.*")


def extracted(queries: DataFrame, blocks: DataFrame, ends: str = "。；！？;!?", lines: int = 4, longest: int = 320) -> DataFrame:
    """(query_id, query, answer): of each block its sentence with most of the query's tokens (a number with a unit counts 0.12),
    the best `lines` of them, marked with the block's number. Queries without usable blocks get the fixed refusal."""
    text = F.regexp_replace(F.regexp_extract("block", r"(?s)^[^\n]*\n(.*)$", 1), "【[^】]{0,120}】", " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*#{1,6}\s*", ""), r"\s+", " "), r"^\s+|\s+$", "")
    b = blocks.select("query_id", "index_no", text.alias("body")).where("length(body) >= 10")
    said = F.filter(F.transform(F.split("body", f"(?<=[{ends}])"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    b = b.select("query_id", "index_no", F.when(F.size(said) > 0, said).otherwise(F.array(F.substring("body", 1, 200))).alias("s"), (F.size(said) > 0).alias("whole"))
    b = b.select("query_id", "index_no", "whole", F.posexplode("s").alias("at", "s")).join(queries.select("query_id", F.array_distinct(T.tokenize(F.col("query"))).alias("q")), "query_id")
    score = F.size(F.array_intersect("q", T.tokenize(F.col("s")))) / F.greatest(F.size("q"), F.lit(1)) + F.when(F.col("s").rlike(MEASURE), 0.12).otherwise(0.0)
    b = b.withColumn("score", F.when(F.col("whole"), F.round(score, 6)).otherwise(0.0))
    best = b.withColumn("r", F.row_number().over(W.partitionBy("query_id", "index_no").orderBy(F.desc("score"), "at"))).where("r = 1")
    first = W.partitionBy("query_id", F.substring("s", 1, 40)).orderBy(F.desc("score"), "index_no")
    best = best.withColumn("r", F.row_number().over(first)).where("r = 1")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "index_no"))).where(F.col("r") <= lines)
    line = F.concat(F.lit("- "), T.truncate_to(F.col("s"), longest), F.lit(" ["), F.col("index_no").cast("string"), F.lit("]"))
    a = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    whole = F.array_join(F.concat(F.array(F.lit(ANSWER_HEAD)), F.col("lines"), F.array(F.lit(ANSWER_NOTE))), "\n")
    return queries.select("query_id", "query").join(a, "query_id", "left").select("query_id", "query", F.coalesce(whole, F.lit(NO_CONTEXT)).alias("answer"))


def search_rows(found: DataFrame, queries: DataFrame, docs: DataFrame, cut: int = 500) -> DataFrame:
    """Candidates (query_id, doc_id, rank, fusion_score) with title, content cut for display and the sorted terms that query and
    document share; a candidate whose document is gone stays, without them."""
    found = written(found, "found")
    c = found.join(queries.select("query_id", "query"), "query_id").join(fetched(docs.select("doc_id", "title", "text"), found, "doc_id", "found-texts"), "doc_id", "left")
    shared = F.array_sort(F.array_intersect(F.array_distinct(T.tokenize(F.col("query"))), T.tokenize(F.col("text"))))
    return c.select("query_id", "doc_id", "rank", "fusion_score", T.text_or_empty(F.col("title")).alias("title"), T.truncate_to(T.text_or_empty(F.col("text")), cut).alias("content"), shared.alias("matched_terms"))


def explained(found: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(query_id, n, n_both, n_vector_only, n_bm25_only, best, weak) of fused candidates: which channel found them."""
    v, b = F.col("vector_rank").isNotNull(), F.col("bm25_rank").isNotNull()
    return found.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(v & b).alias("n_both"), F.count_if(v & ~b).alias("n_vector_only"), F.count_if(b & ~v).alias("n_bm25_only"),
        F.max("fusion_score").alias("best"), (F.max("fusion_score") < threshold * 2).alias("weak"),
    )


def attributed(found: DataFrame, floor: float = 0.45, scattered: float = 0.6) -> DataFrame:
    """Why a query missed: `reasons` (confidence, code), surest first, and `verdict`, from rows (query_id, n_intent, n_broad: candidates within
    the intent's domains and anywhere; top_fusion, top_broad, top_rerank, mean_bm25, mean_vector; intent_confidence; most_of_one: the
    most candidates of one document). What is null counts as 0. Pieces of one document count as scattered below a best fusion of `scattered`."""
    names = ("n_intent", "n_broad", "top_fusion", "top_broad", "top_rerank", "mean_bm25", "mean_vector", "intent_confidence", "most_of_one")
    n_intent, n_broad, fusion, broad, rerank, bm25, vector, sure, most = (F.coalesce(F.col(c), F.lit(0)) for c in names)
    reason = lambda code, conf: F.struct(F.lit(conf).alias("confidence"), F.lit(code).alias("code"))
    missing = F.when((n_intent == 0) & (n_broad == 0), reason("missing_doc", 0.95)).when((n_intent > 0) & (rerank < floor * 0.6), reason("missing_doc", 0.7))
    misroute = F.when((n_intent == 0) & (n_broad > 0), reason("intent_misroute", 0.85)).when((n_intent > 0) & (broad > fusion * 1.3) & (n_broad > n_intent), reason("intent_misroute", 0.6)).when(sure < 0.5, reason("intent_misroute", 0.4))
    drift = F.when((n_intent > 0) & (bm25 > 0) & (vector > 0) & (bm25 > vector * 1.6) & (rerank >= floor * 0.5), reason("rewrite_drift", 0.5))
    split = F.when((most >= 3) & (fusion < scattered) & (rerank >= floor * 0.5), reason("chunking_bad", 0.45))
    reasons = F.sort_array(F.filter(F.array(missing, misroute, drift, split), lambda x: x.isNotNull()), asc=False)
    has = lambda code: F.exists("reasons", lambda x: x["code"] == code)
    verdict = F.when(F.size("reasons") == 0, "retrieval_ok")
    for code in ("missing_doc", "intent_misroute", "chunking_bad"):
        verdict = verdict.when(has(code), code)
    return found.withColumn("reasons", reasons).withColumn("verdict", verdict.otherwise("rewrite_drift"))
