"""Messages in five locales, as a lookup table and as expressions.

Wording is this project's own; the keys are what the renderer asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = {
    "en": {
        "title": "Sifted context", "contents": "Contents", "project_map": "Project map", "task_context": "Task", "code": "Code in depth", "instructions": "Instructions",
        "priority": "Priority", "file": "File", "language": "Language", "reason": "Reason", "distance": "Distance", "dependencies": "Dependencies", "task": "Task", "budget": "Token budget",
        "tokenizer": "Tokenizer", "high": "High files", "medium": "Medium files", "low": "Low files", "heading": "{priority} priority", "summary": "Summary", "none": "none", "not_available": "n/a",
        "minimal": "Shortened strongly to keep within the limit.", "emergency": "Shortened to the bare task.", "omitted": "no room for code within this limit",
        "debug": "[Debug] Budget: {budget}, Used: {used}, Strategy: {strategy}.", "warning": "Shortened strongly to fit {limit}", "body": "Work from the files above. HIGH files are complete, MEDIUM files show contracts, LOW files give orientation only.",
        "task_match": "task words found ({matches})", "core_arch": "imported by share {centrality}", "graph_distance": "graph distance {distance}", "android_source": "Android source", "source_file": "source file",
        "entry_point": "entry point", "config_match": "configuration the task asks for", "boilerplate_penalty": "boilerplate", "config_priority_cap": "configuration limit", "background_context": "background", "final_score": "score {final_score}",
    },
    "ru": {"title": "Отобранный контекст", "project_map": "Карта проекта", "task_context": "Задача", "code": "Код подробно", "none": "нет", "not_available": "н/д", "task_match": "слова задачи ({matches})", "core_arch": "доля импортов {centrality}", "graph_distance": "расстояние {distance}", "source_file": "исходный файл", "entry_point": "точка входа", "background_context": "фон", "final_score": "оценка {final_score}"},
    "zh": {"title": "筛选后的上下文", "project_map": "项目地图", "task_context": "任务", "code": "代码", "none": "无", "not_available": "无", "task_match": "任务词匹配 ({matches})", "core_arch": "被引用比例 {centrality}", "graph_distance": "图距离 {distance}", "source_file": "源文件", "entry_point": "入口", "background_context": "背景", "final_score": "得分 {final_score}"},
    "ja": {"title": "選別した文脈", "project_map": "プロジェクト地図", "task_context": "課題", "code": "コード", "none": "なし", "not_available": "なし", "task_match": "課題の語 ({matches})", "core_arch": "被参照率 {centrality}", "graph_distance": "グラフ距離 {distance}", "source_file": "ソース", "entry_point": "入口", "background_context": "背景", "final_score": "得点 {final_score}"},
    "hi": {"title": "छना हुआ संदर्भ", "project_map": "परियोजना मानचित्र", "task_context": "कार्य", "code": "कोड", "none": "कोई नहीं", "not_available": "उपलब्ध नहीं", "task_match": "कार्य के शब्द ({matches})", "core_arch": "आयात अंश {centrality}", "graph_distance": "ग्राफ दूरी {distance}", "source_file": "स्रोत फ़ाइल", "entry_point": "प्रवेश", "background_context": "पृष्ठभूमि", "final_score": "अंक {final_score}"},
}
JOB_CODES = {
    "jobQueued": "Waiting", "jobStarted": "Started", "jobScanning": "Reading files", "jobRanking": "Ranking files",
    "jobRendering": "Writing the document", "jobCompleted": "Done", "jobFailed": "Failed", "jobInterrupted": "Interrupted",
}


def text(key: str, locale: Column | None = None) -> Column:
    """The template of ``key``: in the locale, else in English, else the key itself."""
    out = F.lit(MESSAGES["en"].get(key, key))
    if locale is not None:
        for loc, known in MESSAGES.items():
            if key in known and loc != "en":
                out = F.when(locale == loc, known[key]).otherwise(out)
    return out


def fill(template: Column, **values: Column) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


def catalogue(spark: SparkSession) -> DataFrame:
    """(locale, key, template) with English where a locale lacks a key."""
    rows = [(loc, k, known.get(k, en)) for loc, known in MESSAGES.items() for k, en in MESSAGES["en"].items()]
    return spark.createDataFrame(rows, "locale string, key string, template string")
