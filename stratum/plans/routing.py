"""Routing rules, task lists and worker allocation, as expressions over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import any_of, clamped_int, collapsed, column, compact, count_of, trimmed
from stratum.plans.config import CHUNKS_PER_WORKER, ROLE_BUDGETS, SPECIALISTS, Limits

# The terms that the rules look for.
COMPOUND = ("同时", "分别", "逐项", "以及", "并且", "、", "；")
COMPARE = ("比较", "对比", "差异", "异同")
RISK = ("风险", "矛盾", "冲突", "缺口", "核实", "审查")
SUMMARY = ("总结", "概括", "主要内容", "全文要点", "核心内容")
RISK_ROLE = ("风险", "矛盾", "缺口", "核实", "审查")
ANALYSE = ("分析", "总结", "归纳", "原因", "影响")
FACT = "(是什么|有哪些|多少|哪[个些]?|谁|何时|何地|是否|提取|查找|找出)"
EXHAUSTIVE = ("全部", "所有", "完整清单", "逐条", "逐项", "员工信息", "员工名单")
BROAD = ("总结", "概括", "全文", "主要内容", "核心内容", "要点", "文档开头", "文档末尾")
REFERENTIAL = ("这个", "该内容", "上述", "前面", "刚才", "它", "其", "这些", "他们")
COMPLEX = ("同时", "分别", "逐项", "以及", "并且", "、", "；", "比较", "风险")
GREETINGS = ("你好", "您好", "你是谁", "你能做什么", "谢谢", "帮我写", "写一段", "翻译", "润色", "改写", "生成代码", "写代码", "解释一下")
READ_VETO = ("总结", "概括", "分析", "评价", "比较", "风险", "结论", "解释", "为什么")
READ_TERMS = ("输出pdf内容", "显示pdf内容", "读取pdf内容", "阅读pdf内容", "输出全文", "显示全文", "读取全文", "查看全文", "输出原文", "显示原文", "查看原文", "逐页输出", "全部内容")
PAGE_TERMS = ("输出", "显示", "读取", "查看", "原文", "内容", "提取")
PAGE_VETO = ("总结", "概括", "分析", "比较", "评价", "为什么", "结论", "风险")
PAGE_RANGE = r"(?:第\s*)?(\d{1,4})\s*(?:[-—–~～]|至|到)\s*(\d{1,4})\s*页|第\s*(\d{1,4})\s*页"
MOST_PAGES = 101


def intent(question: Column | str) -> Column:
    """Name of the first rule that fits; compound and open questions are left to the model."""
    q = compact(question)
    return (
        F.when(any_of(q, COMPOUND), "compound_research")
        .when(any_of(q, COMPARE), "comparison")
        .when(any_of(q, RISK), "risk_review")
        .when(any_of(q, SUMMARY), "document_summary")
        .when(q.rlike(FACT), "fact_lookup")
        .otherwise("open_research")
    )


def agent_type(objective: Column | str) -> Column:
    q = column(objective)
    return F.when(any_of(q, RISK_ROLE), "risk_reviewer").when(any_of(q, COMPARE), "comparator").when(any_of(q, ANALYSE), "analyst").otherwise("fact_extractor")


def scope(question: Column | str, has_document: Column | bool = True, asked: Column | None = None) -> Column:
    ruled = F.when(~F.lit(has_document) if isinstance(has_document, bool) else ~has_document, "general").when(compact(question).rlike("^(" + "|".join(GREETINGS) + ")"), "general").otherwise("document")
    return ruled if asked is None else F.when(asked.isin("general", "document"), asked).otherwise(ruled)


def reads_directly(question: Column | str, flag: Column | None = None) -> Column:
    q = compact(question)
    ruled = ~any_of(q, READ_VETO) & any_of(q, READ_TERMS)
    return ruled if flag is None else F.coalesce(flag, F.lit(False)) | ruled


def page_range(question: Column | str) -> Column:
    """(start, end, valid); null if no page is named."""
    q = column(question)
    a, b, one = F.regexp_extract(q, PAGE_RANGE, 1), F.regexp_extract(q, PAGE_RANGE, 2), F.regexp_extract(q, PAGE_RANGE, 3)
    start = F.when(a != "", a).otherwise(F.nullif(one, F.lit(""))).try_cast("int")
    end = F.when(b != "", b).otherwise(F.nullif(one, F.lit(""))).try_cast("int")
    valid = (start >= 1) & (end >= start) & (end - start < MOST_PAGES)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), valid.alias("valid")))


def asks_page_content(question: Column | str) -> Column:
    q = compact(question)
    return any_of(q, PAGE_TERMS) & ~any_of(q, PAGE_VETO)


def is_exhaustive(text: Column | str) -> Column:
    return any_of(compact(text), EXHAUSTIVE)


def needs_coverage(kind: Column | str, text: Column | str) -> Column:
    return (column(kind) == "analyst") | any_of(compact(text), BROAD)


def with_memory(query: Column | str, memory: Column) -> Column:
    """The query, and after it the memory if it refers back."""
    q = column(query)
    return F.when((F.coalesce(memory, F.lit("")) != "") & any_of(q, REFERENTIAL), F.concat(q, F.lit("\n"), memory)).otherwise(q)


def complexity(question: Column | str, max_workers: int) -> Column:
    q = collapsed(question, "")
    marks = sum((count_of(q, m) for m in COMPLEX), F.lit(0))
    return F.least(F.lit(max_workers), (1 + marks + F.floor(F.length(q) / 500)).cast("int"))


def allocation(questions: DataFrame, limits: Limits, indexed_bytes: int, n_chunks: int, n_base: Column | int = 1) -> DataFrame:
    """Workers wanted and allocated for each row of ``questions`` (question)."""
    exhaustive = any_of(collapsed("question", ""), EXHAUSTIVE)
    target = F.when(exhaustive, limits.shard_bytes // 2).otherwise(limits.shard_bytes)
    need = F.greatest(
        F.lit(limits.default_agents),
        F.lit(n_base) if isinstance(n_base, int) else n_base,
        F.greatest(F.lit(1), F.ceil(F.lit(indexed_bytes) / target)).cast("int"),
        F.lit(max(1, -(-n_chunks // CHUNKS_PER_WORKER))),
        complexity("question", limits.max_workers),
    )
    return questions.withColumn("exhaustive_scan", exhaustive).withColumn("target_shard_bytes", target).withColumn("desired_agents", need).withColumn("allocated_agents", F.least(F.lit(limits.max_workers), need))


def shard_of(chunk_ord: Column | str, n_chunks: int, shards: Column | int) -> Column:
    """The shard that holds a chunk, for no more shards than chunks: the inverse of the ranges' starts."""
    k = F.lit(shards) if isinstance(shards, int) else shards
    return F.floor(((column(chunk_ord) + 1) * k - 1) / n_chunks).cast("int")


def slots(allocated: DataFrame, n_chunks: int) -> DataFrame:
    """A row for each slot with its range of chunks; more slots than chunks share them in turn."""
    slot = F.col("slot").cast("long")
    k = F.col("allocated_agents")
    start = F.when(F.lit(n_chunks) == 0, 0).when(k <= n_chunks, F.floor(slot * n_chunks / k)).otherwise(slot % max(1, n_chunks)).cast("long")
    end = F.when(F.lit(n_chunks) == 0, 0).when(k <= n_chunks, F.floor((slot + 1) * n_chunks / k)).otherwise(slot % max(1, n_chunks) + 1).cast("long")
    return allocated.withColumn("slot", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("chunk_start", start).withColumn("chunk_end", end)


def shard_sizes(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ranges`` (slot, chunk_start, chunk_end; 32 rows at most a question) with the chunks and bytes they hold."""
    inside = (F.col("chunk_ord") >= F.col("chunk_start")) & (F.col("chunk_ord") < F.col("chunk_end"))
    held = chunks.select("chunk_ord", "byte_size").join(F.broadcast(ranges.select("slot", "chunk_start", "chunk_end")), inside).groupBy("slot").agg(F.count(F.lit(1)).alias("shard_chunks"), F.sum("byte_size").alias("shard_bytes"))
    return ranges.join(held, "slot", "left").fillna(0, ["shard_chunks", "shard_bytes"])


def normalised_tasks(raw: DataFrame, max_workers: int) -> DataFrame:
    """Tasks of (question_id, question, items): items is an array of (objective, query, agent_type, priority), where a
    null item is one that isn't an object and ends the list.

    Blank items and repeats of (objective, query) are skipped; ``max_workers`` remain, or one for the question itself.
    Ids follow the order before tasks are sorted by falling priority.
    """
    usable = F.slice("items", 1, F.when(F.exists("items", lambda x: x.isNull()), F.array_position(F.transform("items", lambda x: x.isNull()), True).cast("int") - 1).otherwise(F.size("items")))
    items = raw.select("question_id", "question", F.posexplode_outer(usable).alias("at", "item"))
    objective = F.left(trimmed(F.coalesce("item.objective", F.lit(""))), F.lit(500))
    query = F.left(trimmed(F.coalesce("item.query", objective)), F.lit(500))
    given = trimmed(F.coalesce("item.agent_type", F.lit("fact_extractor")))
    shaped = items.select("question_id", "question", "at", objective.alias("objective"), query.alias("query"), F.when(given.isin(*SPECIALISTS), given).otherwise(agent_type(objective)).alias("agent_type"), clamped_int("item.priority", 1, 100, 50).alias("priority"))
    good = shaped.where("objective <> '' AND query <> ''")
    once = good.withColumn("nth", F.row_number().over(W.partitionBy("question_id", F.lower("objective"), F.lower("query")).orderBy("at"))).where("nth = 1")
    kept = once.withColumn("number", F.row_number().over(W.partitionBy("question_id").orderBy("at"))).where(F.col("number") <= max_workers)
    bare = raw.join(kept.select("question_id").distinct(), "question_id", "left_anti")
    own = bare.select("question_id", "question", F.lit(0).alias("at"), F.left("question", F.lit(500)).alias("objective"), F.left("question", F.lit(500)).alias("query"), agent_type("question").alias("agent_type"), F.lit(50).alias("priority"), F.lit(1).alias("nth"), F.lit(1).alias("number"))
    budget = F.create_map(*[x for r in SPECIALISTS for x in (F.lit(r), F.lit(min(16_000, ROLE_BUDGETS[r])))])
    order = W.partitionBy("question_id").orderBy(F.col("priority").desc(), "number")
    return kept.unionByName(own).select("question_id", F.format_string("task_%02d", "number").alias("task_id"), "objective", "query", "agent_type", "priority", budget[F.col("agent_type")].alias("input_budget"), F.row_number().over(order).alias("position"))


def allocated_tasks(tasks: DataFrame, ranges: DataFrame, question: str) -> DataFrame:
    """Base tasks dealt in turn over the slots of one question; the question is added to queries that don't hold it."""
    n_base = tasks.count()
    lower = F.lower(F.col("query"))
    combined = F.when(F.contains(lower, F.lower(F.lit(question))), F.col("query")).otherwise(trimmed(F.concat(F.col("query"), F.lit("\n总体目标：" + question))))
    dealt = ranges.withColumn("position", F.col("slot") % n_base + 1).join(F.broadcast(tasks.withColumnRenamed("task_id", "base_task_id")), "position")
    number = F.col("slot") + 1
    return dealt.select(
        F.format_string("task_%02d", number).alias("task_id"), "base_task_id", "objective", F.left(combined, F.lit(1000)).alias("query"), "agent_type", "priority", "input_budget", F.format_string("%s_%02d", F.col("agent_type"), number).alias("agent_instance_id"),
        number.alias("shard_index"), F.col("allocated_agents").alias("shard_count"), "chunk_start", "chunk_end", "shard_chunks", "shard_bytes",
    )


# The tasks of a question about the whole document, and which of them fewer workers than three take.
WHOLE_DOCUMENT = (
    {"objective": "概括文档开头的背景、目标与范围", "query": "背景 目标 范围 文档开头", "agent_type": "analyst", "priority": 90},
    {"objective": "归纳文档核心内容并回答：{question}", "query": "{question}", "agent_type": "analyst", "priority": 85},
    {"objective": "检查文档末尾的结论、行动项、限制与风险", "query": "结论 行动项 限制 风险 文档末尾", "agent_type": "analyst", "priority": 80},
)
TAKEN_BY = {1: (1,), 2: (0, 2)}


def controlled_tasks(question: str, max_workers: int) -> list[dict]:
    """The fixed tasks of a question about the whole document, as many as there are workers for."""
    rows = [WHOLE_DOCUMENT[i] for i in TAKEN_BY.get(max_workers, range(len(WHOLE_DOCUMENT)))]
    return [{k: v.replace("{question}", question) if isinstance(v, str) else v for k, v in row.items()} for row in rows]
