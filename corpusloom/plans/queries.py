"""Registered queries of the reference's operators, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import links, tokens
from ..functions import messages as M
from ..functions import text as T
from ..operators import budget, compress, graph, imports, jobs, rank, render, report, resolve, running, scan
from ..sources.tables import cut, removed_at_end, shared_dir, spread, table
from . import context, virtual
from .virtual import DUCK_EDGES, DUCK_FILES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Pieces of DuckDB SQL.
NAME = "regexp_extract({p}, '([^/]*)$', 1)"
SUF = f"lower(regexp_extract({NAME}, '^.+[.]([^.]+)$', 1))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def lang_sql(p: str) -> str:
    by_name = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.NAME_LANGUAGE.items())
    by_suffix = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SUFFIX_LANGUAGE.items())
    return f"coalesce(CASE lower({NAME.format(p=p)}) {by_name} END, CASE {SUF.format(p=p)} {by_suffix} END, 'unknown')"


def cat_sql(p: str) -> str:
    return f"CASE WHEN {SUF.format(p=p)} IN {_in(C.SOURCE_SUFFIXES)} THEN 'source_code' WHEN {SUF.format(p=p)} IN {_in(C.CONFIG_SUFFIXES)} OR lower({NAME.format(p=p)}) IN {_in(C.NAME_LANGUAGE)} THEN 'config_data' ELSE 'asset' END"


ENTRY = f"(regexp_matches(relative_path, '^src/[^/]+$') OR lower({NAME.format(p='relative_path')}) IN {_in(C.ENTRY_NAMES)})"
BOILER = f"(regexp_matches(lower({NAME.format(p='relative_path')}), '^test_.*[.]py$') OR lower({NAME.format(p='relative_path')}) IN ('constants.py', 'types.ts'))"
ANDROID = "regexp_matches(lower(relative_path), '(^|/)src/main/(java|kotlin)(/|$)')"
WORDS = ["roster", "ledger", "invoice"]
LEX = " + ".join(f"((length(h) - length(replace(h, '{w}', ''))) // {len(w)})" for w in WORDS)
DUCK_LEX = f"lx AS (SELECT doc_id, relative_path, scan_ord, octet_length(encode(text)) AS n_bytes, CAST({LEX} AS BIGINT) AS s FROM (SELECT *, lower(concat(relative_path, chr(10), substring(text, 1, 50000))) AS h FROM v))"
DUCK_UND = "und AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b)"
DUCK_BFS = f"{DUCK_UND}, w(node, d) AS (SELECT relative_path, 0 FROM lx WHERE s > 0 UNION SELECT und.b, w.d + 1 FROM w JOIN und ON und.a = w.node WHERE w.d < 9), ds AS (SELECT node, min(d) AS d FROM w GROUP BY node)"
DUCK_DEG = "ind AS (SELECT dst, count(*) AS k FROM e GROUP BY dst), cen AS (SELECT v.relative_path, coalesce(k, 0) AS k, coalesce(k, 0) / (SELECT count(*) - 1 FROM v) AS c FROM v LEFT JOIN ind ON dst = v.relative_path)"
DUCK_SCORE = f"""sc AS (SELECT lx.*, c, d, {cat_sql('lx.relative_path')} AS cat FROM lx JOIN cen USING (relative_path) LEFT JOIN ds ON node = lx.relative_path),
 s1 AS (SELECT *, (CASE WHEN s = 0 THEN 0.0 ELSE 1.0 + least(2.5, ln(1 + s) * 1.4) END) + c * 1.6 * (CASE WHEN d IS NULL THEN 0.25 WHEN d <= 1 THEN 1.0 ELSE exp(-1.25 * (d - 1)) END)
   + (CASE WHEN d IS NULL THEN 0.0 WHEN d <= 1 THEN 0.85 ELSE 0.85 * exp(-1.25 * (d - 1)) END) + (CASE WHEN {ENTRY} THEN 0.2 ELSE 0.0 END)
   + (CASE WHEN cat = 'source_code' THEN 0.05 ELSE 0.0 END) + (CASE WHEN {ANDROID} THEN 0.45 ELSE 0.0 END) AS x0, {BOILER} AND s = 0 AS boiler FROM sc),
 s2 AS (SELECT *, CASE WHEN boiler THEN x0 * 0.35 ELSE x0 END AS x1 FROM s1),
 s3 AS (SELECT *, CASE WHEN cat = 'config_data' THEN CASE WHEN s > 0 THEN least(x1 * 0.55, 0.95) ELSE x1 * 0.2 END ELSE x1 END AS x FROM s2),
 rk AS (SELECT *, CASE WHEN cat = 'config_data' THEN CASE WHEN s > 0 AND x >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END WHEN boiler THEN CASE WHEN x >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END
   WHEN x >= 1.0 AND (s > 0 OR c >= 0.25 OR ({ENTRY} AND coalesce(d IN (0, 1), false))) THEN 'HIGH' WHEN x >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS priority
   FROM s3 WHERE x >= 0.3 AND NOT (s = 0 AND n_bytes > 20000))"""
WITH_V = f"WITH RECURSIVE {DUCK_FILES}"
WITH_E = f"{WITH_V}, {DUCK_EDGES}"
WITH_BFS = f"{WITH_E}, {DUCK_LEX}, {DUCK_BFS}"
WITH_RANK = f"{WITH_BFS}, {DUCK_DEG}, {DUCK_SCORE}"
NORMP = "replace(relative_path, chr(92), '/')"


def _v(s, d):
    return virtual.files(s, d)


def _ranked(s, d):
    return cut(rank.ranked(_v(s, d).select("relative_path", "text", "scan_ord"), virtual.edges(s, d), [], virtual.words()))


# ---- scans -----------------------------------------------------------------

PARTS = "string_split({p}, '/')"
IGN = f"len(list_intersect({PARTS.format(p=NORMP)}, {list(scan.IGNORED_DIRS)})) > 0"
IGP = f"(len(list_intersect({PARTS.format(p=f'lower({NORMP})')}, ['.gradle', '.idea', 'build'])) > 0 OR regexp_matches(lower({NORMP}), '(^|/)res/raw(/|$)'))"
TEST = f"regexp_matches(lower({NORMP}), '(^|/)tests?/|(^|/)test_[^/]*$|_test[.]py$|[.](test|spec)[.][jt]sx?$')"
BIN = f"{SUF.format(p=NORMP)} IN {_in(scan.BINARY_SUFFIXES)}"


@query("scan_ignore_filter", f"SELECT repo, count(*) AS n_files FROM source_files WHERE NOT {IGN} AND NOT {IGP} AND NOT {BIN} GROUP BY repo")
def scan_ignore_filter(s, d):
    return scan.scanned(table(s, d, "source_files", "repo", "relative_path")).groupBy("repo").agg(F.count("*").alias("n_files"))


@query("scan_test_filter", f"SELECT file_id, relative_path FROM source_files WHERE NOT {IGN} AND NOT {IGP} AND NOT {BIN} AND NOT {TEST}")
def scan_test_filter(s, d):
    return scan.scanned(table(s, d, "source_files", "file_id", "relative_path"), include_tests=False).select("file_id", "relative_path")


@query(
    "scan_browser_ingest",
    f"""SELECT input_id FROM (SELECT input_id, row_number() OVER (PARTITION BY repo ORDER BY input_id) AS n FROM (SELECT *, replace(name, chr(92), '/') AS p FROM input_files)
    WHERE {SUF.format(p='p')} NOT IN {_in(scan.BROWSER_BINARY)} AND len(list_intersect({PARTS.format(p='p')}, {list(scan.BROWSER_IGNORED)})) = 0 AND NOT regexp_matches(lower(p), '(^|/)res/raw(/|$)')
    AND NOT regexp_matches(lower(p), '(^|/)([.]ds_store|package-lock[.]json)$') AND coalesce(octet_length(encode(content)), 0) <= 500000) WHERE n <= 400""",
)
def scan_browser_ingest(s, d):
    f = table(s, d, "input_files", "input_id", "repo", "name", "content")
    return scan.browser_ingest(f, ["repo"], "name", ["input_id"], F.coalesce(F.octet_length("content"), F.lit(0))).select("input_id")


NORM_CTE = """n AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(replace(coalesce(name, ''), chr(92), '/'), '/'), lambda x: x NOT IN ('', '.', '..')), '/'), ''), concat('snippet_', file_ord + 1, '.txt')) AS norm FROM input_files),
 r AS (SELECT *, row_number() OVER (PARTITION BY request_id, norm ORDER BY file_ord, input_id) AS k, regexp_extract(norm, '([^/]*)$', 1) AS base FROM n),
 q AS (SELECT request_id, input_id, file_ord, content, CASE WHEN k = 1 THEN norm WHEN regexp_matches(base, '^.+[.][^.]+$') THEN concat(regexp_replace(norm, '[.][^./]+$', ''), '_', file_ord + 1, regexp_extract(norm, '([.][^./]+)$', 1)) ELSE concat(norm, '_', file_ord + 1) END AS relative_path FROM r)"""


@query("name_normalize_dedupe", f"WITH {NORM_CTE} SELECT request_id, input_id, relative_path FROM q WHERE NOT {IGP}")
def name_normalize_dedupe(s, d):
    return scan.request_files(table(s, d, "input_files", "request_id", "input_id", "file_ord", "name", "content")).select("request_id", "input_id", "relative_path")


@query("replace_by_name", "SELECT repo, name, max(input_id) AS input_id FROM input_files GROUP BY repo, name")
def replace_by_name(s, d):
    return scan.replace_by_name(table(s, d, "input_files", "repo", "name", "input_id"))


_LIMIT = "least(greatest(coalesce(token_limit, 8000), 1), 1000000)::BIGINT"


@query("settings_link_roundtrip", f"SELECT request_id, coalesce(task, '') AS task, {_LIMIT} AS token_limit, CASE WHEN locale IN ('en', 'ru', 'zh', 'ja', 'hi') THEN locale ELSE 'en' END AS locale FROM requests")
def settings_link_roundtrip(s, d):
    r = table(s, d, "requests", "request_id", "task", "token_limit", "locale")
    link = links.packed(F.col("task"), F.col("token_limit"), F.col("locale"))
    return r.select("request_id", links.unpacked(link).alias("v")).select("request_id", "v.*")


@query("settings_link_invalid", "SELECT request_id, true AS broken, true AS foreign_text FROM requests")
def settings_link_invalid(s, d):
    r = table(s, d, "requests", "request_id", "task", "token_limit", "locale")
    link = links.packed(F.col("task"), F.col("token_limit"), F.col("locale"))
    # Cut off in front, and not of the alphabet.
    return r.select("request_id", links.unpacked(F.substring(link, 6, 10_000)).isNull().alias("broken"), links.unpacked(F.concat(link, F.lit("?"))).isNull().alias("foreign_text"))


@query(
    "feedback_validate",
    """WITH f AS (SELECT event_id, CASE lower(trim(status)) WHEN 'completed' THEN 'positive' WHEN 'failed' THEN 'negative' ELSE 'other' END AS kind, message, coalesce(message_code, '') AS code, coalesce(error, '') AS error, job_id FROM job_events)
    SELECT event_id, kind, left(trim(message), 4096) AS message, concat_ws(' ', CASE WHEN code <> '' THEN 'code=' || left(code, 1024) END, CASE WHEN error <> '' THEN 'error=' || left(error, 1024) END, 'job=' || job_id) AS fields
    FROM f WHERE kind IN ('positive', 'negative') AND length(trim(message)) > 0""",
)
def feedback_validate(s, d):
    e = table(s, d, "job_events", "event_id", "job_id", "status", "message", "message_code", "error")
    state = F.lower(F.trim("status"))
    kind = F.when(state == "completed", "positive").when(state == "failed", "negative").otherwise("other")
    meta = F.create_map(F.lit("job"), "job_id", F.lit("error"), "error", F.lit("code"), "message_code")
    out = report.feedback(e.select("event_id", kind.alias("kind"), "message", meta.alias("metadata")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return out.select("event_id", "kind", "message", shown.alias("fields"))


# ---- classification and text -------------------------------------------------


@query(
    "classify_files",
    f"""SELECT file_id, {lang_sql(NORMP)} AS language, coalesce(nullif(detected_language, 'unknown'), {lang_sql(NORMP)}) AS effective, {cat_sql(NORMP)} AS category,
    {ENTRY} AS entrypoint, {BOILER} AS boilerplate, {ANDROID} AS android FROM source_files""",
)
def classify_files(s, d):
    p = F.regexp_replace("relative_path", r"\\", "/")
    return table(s, d, "source_files", "file_id", "relative_path", "detected_language").select(
        "file_id", C.language_of(p).alias("language"), C.effective_language("detected_language", p).alias("effective"), C.category_of(p).alias("category"), C.is_entrypoint("relative_path").alias("entrypoint"),
        C.is_boilerplate("relative_path").alias("boilerplate"), C.is_android_source("relative_path").alias("android"),
    )


@query("fence_languages", f"SELECT coalesce(detected_language, '') AS language, max(CASE WHEN detected_language IN {_in(C.FENCED)} THEN detected_language ELSE '' END) AS fence, count(*) AS n_files FROM source_files GROUP BY 1")
def fence_languages(s, d):
    return table(s, d, "source_files", "detected_language").groupBy(F.coalesce("detected_language", F.lit("")).alias("language")).agg(F.max(C.fence_of("detected_language")).alias("fence"), F.count("*").alias("n_files"))


TERMS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(task, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 2{more})))"


@query(
    "task_terms",
    f"""SELECT request_id, array_to_string({TERMS.format(more=f" AND x NOT IN {_in(T.STOP_WORDS)}")}, ' ') AS rank_terms, array_to_string({TERMS.format(more='')}, ' ') AS snippet_terms,
    len(list_intersect({TERMS.format(more='')}, {C.CONFIG_TERMS})) > 0 AS wants_config FROM requests WHERE task IS NOT NULL""",
)
def task_terms(s, d):
    r = table(s, d, "requests", "request_id", "task").where("task is not null")
    a, b = T.terms("task"), T.terms("task", stop=False)
    return r.select("request_id", F.array_join(F.array_sort(a), " ").alias("rank_terms"), F.array_join(F.array_sort(b), " ").alias("snippet_terms"), F.arrays_overlap(b, F.array(*map(F.lit, C.CONFIG_TERMS))).alias("wants_config"))


@query("token_limits", """SELECT request_id, CASE WHEN token_limit >= 1000 AND token_limit % 1000 = 0 THEN concat(token_limit::BIGINT // 1000, 'k') ELSE concat(format('{:,}', token_limit::BIGINT), ' tokens') END AS shown,
    token_limit::BIGINT AS parsed FROM requests WHERE token_limit IS NOT NULL""")  # fmt: skip
def token_limits(s, d):
    r = table(s, d, "requests", "request_id", "token_limit").where("token_limit is not null").withColumn("token_limit", F.col("token_limit").cast("long"))
    shown = T.format_limit("token_limit")
    return r.select("request_id", shown.alias("shown"), T.parse_limit(F.regexp_replace(F.regexp_replace(shown, " tokens", ""), ",", "")).alias("parsed"))


@query("request_locales", """SELECT CASE WHEN split_part(lower(coalesce(locale, 'en')), '-', 1) IN ('en', 'ru', 'zh', 'ja', 'hi') THEN split_part(lower(coalesce(locale, 'en')), '-', 1) ELSE 'en' END AS loc, count(*) AS n FROM requests GROUP BY 1""")
def request_locales(s, d):
    return table(s, d, "requests", "locale").groupBy(T.normalize_locale("locale").alias("loc")).agg(F.count("*").alias("n"))


_CATALOGUE = ", ".join(f"('{loc}', '{k}', '{known.get(k, en).replace(chr(39), chr(39) * 2)}')" for loc, known in M.MESSAGES.items() for k, en in M.MESSAGES["en"].items())
_LOC = "CASE WHEN split_part(lower(coalesce(locale, 'en')), '-', 1) IN ('en', 'ru', 'zh', 'ja', 'hi') THEN split_part(lower(coalesce(locale, 'en')), '-', 1) ELSE 'en' END"


@query("locale_translate", f"WITH m(loc, key, template) AS (VALUES {_CATALOGUE}), r AS (SELECT request_id, {_LOC} AS loc FROM requests) SELECT request_id, loc AS locale, key, template FROM r JOIN m USING (loc)")
def locale_translate(s, d):
    r = table(s, d, "requests", "request_id", "locale").withColumn("locale", T.normalize_locale("locale"))
    return r.join(F.broadcast(M.catalogue(s)), "locale").select("request_id", "locale", "key", "template")


@query("token_costs", """SELECT response_id, CASE WHEN tokens >= 1000 THEN concat(format('{:,.1f}', tokens / 1000.0), 'k') ELSE tokens::VARCHAR END AS shown, concat('$', format('{:,.2f}', tokens * 0.000015)) AS cost FROM sift_responses WHERE tokens IS NOT NULL""")
def token_costs(s, d):
    r = table(s, d, "sift_responses", "response_id", "tokens").where("tokens is not null")
    return r.select("response_id", T.format_tokens(F.col("tokens")).alias("shown"), T.format_cost(F.col("tokens")).alias("cost"))


@query("contains_task_term", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + " AS found FROM documents WHERE text IS NOT NULL")
def contains_task_term(s, d):
    return table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.contains_term(F.col("text"), virtual.words()).alias("found"))


@query("bpe_tokens")
def bpe_tokens(s, d):
    return spread(table(s, d, "documents", "doc_id", "text"), "doc_id").select("doc_id", tokens.bpe_tokens(F.col("text")).alias("tokens"))


@query("project_names", """SELECT request_id, CASE WHEN count(DISTINCT seg) = 1 AND bool_and(deep) THEN max(seg) ELSE 'Uploaded Project' END AS project FROM (SELECT request_id, string_split(replace(coalesce(name, ''), chr(92), '/'), '/')[1] AS seg,
    contains(replace(coalesce(name, ''), chr(92), '/'), '/') AS deep FROM input_files) GROUP BY request_id""")  # fmt: skip
def project_names(s, d):
    p = F.replace(F.coalesce("name", F.lit("")), F.lit("\\"), F.lit("/"))
    f = table(s, d, "input_files", "request_id", "name").select("request_id", F.split(p, "/")[0].alias("seg"), F.contains(p, F.lit("/")).alias("deep"))
    one = (F.min("seg") == F.max("seg")) & F.bool_and("deep")
    return f.groupBy("request_id").agg(F.when(one, F.max("seg")).otherwise("Uploaded Project").alias("project"))


@query("approx_tokens", "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents")
def approx_tokens(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", T.approx_tokens("text").alias("tokens"))


@query("text_counters", "SELECT file_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, CASE WHEN length(split_part(text, chr(10), 1)) > 220 THEN concat(rtrim(left(split_part(text, chr(10), 1), 220)), ' ...') ELSE split_part(text, chr(10), 1) END AS first_line FROM source_files WHERE text IS NOT NULL")
def text_counters(s, d):
    f = table(s, d, "source_files", "file_id", "text").where("text is not null")
    lines = F.split("text", "\n")
    return f.select("file_id", F.length("text").alias("chars"), F.size(lines).cast("long").alias("lines"), T.trim_line(lines[0]).alias("first_line"))


@query("job_messages", f"""SELECT event_id, CASE message_code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in M.JOB_CODES.items())} ELSE coalesce(message, '') END AS shown FROM job_events""")
def job_messages(s, d):
    e = table(s, d, "job_events", "event_id", "message", "message_code")
    shown = F.try_element_at(F.create_map(*[F.lit(x) for kv in M.JOB_CODES.items() for x in kv]), F.col("message_code"))
    return e.select("event_id", F.coalesce(shown, "message", F.lit("")).alias("shown"))


@query("result_json", "SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(result_json) THEN result_json END, '$.tokens') AS BIGINT) AS tokens, coalesce(json_valid(result_json), false) AS is_json FROM job_events WHERE result_json IS NOT NULL")
def result_json(s, d):
    e = table(s, d, "job_events", "event_id", "result_json").where("result_json is not null")
    return e.select("event_id", F.get_json_object("result_json", "$.tokens").try_cast("long").alias("tokens"), F.expr("try_parse_json(result_json) is not null").alias("is_json"))


# ---- imports -----------------------------------------------------------------


def _extract(name: str) -> str:
    pats = [p.replace("(?md)", "(?m)").replace("'", "''") for p, _g in imports.PATTERNS[name]]
    arrays = [f"regexp_extract_all(text, '{p}', 1)" for p in pats]
    if name == "go":
        inner = rf"(?:^|\s)(?:[A-Za-z_.]\w*\s+)?{imports.Q}".replace("'", "''")
        arrays.append(rf"flatten(list_transform(regexp_extract_all(text, '(?ms)^\s*import\s*\((.*?)\)', 1), lambda b: regexp_extract_all(b, '{inner}', 1)))")
    return f"list_concat({', '.join(arrays)})" if len(arrays) > 1 else arrays[0]


def _family(name: str, langs: list[str]):
    every = _extract(name)
    sql = f"SELECT DISTINCT file_id, unnest({every}) AS import_name FROM (SELECT * FROM source_files WHERE text IS NOT NULL AND coalesce(nullif(detected_language, 'unknown'), {lang_sql(NORMP)}) IN {_in(langs)})"

    @query(f"imports_{name}", sql)
    def run(s, d):
        f = table(s, d, "source_files", "file_id", "relative_path", "detected_language", "text").where("text is not null")
        f = f.where(C.effective_language("detected_language", F.regexp_replace("relative_path", r"\\", "/")).isin(langs))
        return f.select("file_id", F.explode(imports.extracted(F.col("text"), name)).alias("import_name"))


for _n, _l in (("javascript", ["javascript", "typescript"]), ("dotted", ["java", "kotlin", "csharp", "swift"]), ("go", ["go"]), ("rust", ["rust"]), ("c", ["c", "cpp"]), ("php", ["php"]), ("ruby", ["ruby"])):
    _family(_n, _l)
_family("dart", ["dart", "javascript", "typescript"])  # the table holds no Dart; its form of import is found in scripts, too


def _sources(s, d):
    f = table(s, d, "source_files", "file_id", "repo", "relative_path", "text", "detected_language", "scan_ord")
    return f.withColumn("relative_path", F.regexp_replace("relative_path", r"\\", "/")).withColumn("language", C.effective_language("detected_language", "relative_path"))


@query("imports_python")
def imports_python(s, d):
    f = _sources(s, d).where("language = 'python'")
    return f.select("file_id", F.explode(imports.python_imports(F.col("text"))).alias("import_name"))


@query("imports_all_clean", f"""{WITH_V}, i AS (SELECT relative_path AS src, unnest(list_concat(regexp_extract_all(text, '(?m)^import ([A-Za-z_][\\w.]*)[ \\t]*$', 1), regexp_extract_all(text, '(?m)^from ([.\\w]*\\w) import ', 1))) AS import_name FROM v WHERE relative_path LIKE '%.py')
    SELECT DISTINCT src, import_name, replace(import_name, '.', '/') AS module_path FROM i WHERE NOT starts_with(import_name, '.')""")  # fmt: skip
def imports_all_clean(s, d):
    f = virtual.found(s, d).where("language = 'python'").where(~F.startswith("import_name", F.lit(".")))
    return f.select("src", "import_name", F.replace(T.clean_import(F.col("import_name")), F.lit("."), F.lit("/")).alias("module_path"))


# ---- resolution ----------------------------------------------------------------


@query("candidates")
def candidates(s, d):
    f = _sources(s, d)
    return resolve.tried(imports.imports(f.withColumn("text", F.col("text")), ["repo"]), ["repo"])


@query("lookup_keys", f"""{WITH_V}, p AS (SELECT relative_path AS path, string_split(relative_path, '/') AS parts FROM v), t AS (SELECT path, array_to_string(parts[i:], '/') AS key FROM p, unnest(range(2, len(parts) + 1)) AS u(i))
    SELECT key, min(path) AS path FROM t GROUP BY key HAVING count(*) = 1""")  # fmt: skip
def lookup_keys(s, d):
    return resolve.lookup_keys(_v(s, d), []).where("kind = 3").select("key", "path")


@query("package_keys", f"""{WITH_V}, p AS (SELECT relative_path AS path, string_split(relative_path, '/') AS parts FROM v),
    t AS (SELECT path, array_to_string(parts[1:i], '/') AS key FROM p, unnest(range(1, len(parts))) AS u(i) UNION ALL SELECT path, regexp_replace(array_to_string(parts[i:], '/'), '[.]go$', '') FROM p, unnest(range(2, len(parts) + 1)) AS u(i) WHERE path LIKE '%.go')
    SELECT key, min(path) AS path FROM t GROUP BY key""")  # fmt: skip
def package_keys(s, d):
    return resolve.lookup_keys(_v(s, d), []).where("kind = 2").select("key", "path")


_BARE = "regexp_replace(b.relative_path, '[.][a-z]+$', '')"
_IMPORTED = f"CASE WHEN a.src LIKE '%.ts' THEN '/' || b.relative_path WHEN a.src LIKE '%.go' THEN 'mod.example/' || {_BARE} ELSE replace({_BARE}, '/', '.') END"


@query("resolve_first_match", f"{WITH_E} SELECT DISTINCT a.src, {_IMPORTED} AS import_name, b.relative_path AS dst FROM aim a JOIN v b ON b.doc_id = a.t JOIN e ON e.src = a.src AND e.dst = b.relative_path")
def resolve_first_match(s, d):
    return resolve.resolved(virtual.found(s, d), _v(s, d), []).select("src", "import_name", "dst")


@query("edges_distinct", f"{WITH_E} SELECT src, dst FROM e")
def edges_distinct(s, d):
    return resolve.edges(virtual.found(s, d), _v(s, d), [])


@query("repo_edges")
def repo_edges(s, d):
    f = _sources(s, d)
    return resolve.edges(imports.imports(f, ["repo"]), f, ["repo"])


# ---- graph ---------------------------------------------------------------------


@query("in_degree_centrality", f"{WITH_E}, {DUCK_DEG} SELECT relative_path AS node, k AS in_degree, round(c, 9) AS centrality FROM cen")
def in_degree_centrality(s, d):
    return graph.in_degree(_v(s, d), virtual.edges(s, d), []).withColumn("centrality", F.round("centrality", 9))


@query("undirected_edges", f"{WITH_E}, {DUCK_UND} SELECT a AS src, b AS dst FROM und")
def undirected_edges(s, d):
    return graph.undirected(virtual.edges(s, d), [])


@query("bfs_distance", f"{WITH_BFS} SELECT node, d AS distance FROM ds")
def bfs_distance(s, d):
    light = rank.scored(_v(s, d), virtual.words()).select("relative_path", "scan_ord", "lexical_score")
    seeds = graph.seeds(light, [], C.name_of("relative_path").isin(rank.FALLBACK_NAMES))
    return graph.distances(virtual.edges(s, d), seeds, [])


@query("successors_top6", f"{WITH_RANK}, inc AS (SELECT relative_path AS p FROM rk WHERE priority <> 'LOW'), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e WHERE src IN (SELECT p FROM inc) AND dst IN (SELECT p FROM inc)) SELECT src AS node, string_agg(dst, ', ' ORDER BY dst) AS deps FROM k WHERE n <= 6 GROUP BY src")
def successors_top6(s, d):
    inc = _ranked(s, d).where("priority <> 'LOW'")
    return graph.successors(virtual.edges(s, d), inc, []).select("node", F.array_join("deps", ", ").alias("deps"))


@query("induced_subgraph", f"{WITH_RANK} SELECT src, dst FROM e WHERE src IN (SELECT relative_path FROM rk) AND dst IN (SELECT relative_path FROM rk)")
def induced_subgraph(s, d):
    return graph.induced(virtual.edges(s, d), _ranked(s, d), [])


@query("total_degree", f"{WITH_E} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def total_degree(s, d):
    return graph.total_degree(virtual.edges(s, d), [])


TOP_CTE = f"""{WITH_RANK}, dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
 tn AS (SELECT relative_path, priority, x, coalesce(degree, 0) AS degree, CASE priority WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS weight FROM rk LEFT JOIN dg ON node = relative_path ORDER BY weight DESC, round(x, 9) DESC, degree DESC, relative_path LIMIT 120)"""


@query("graph_topk", f"{TOP_CTE} SELECT relative_path, priority, degree, weight FROM tn")
def graph_topk(s, d):
    r = _ranked(s, d).withColumn("importance_score", F.round("importance_score", 9))
    return graph.top_graph(r, virtual.edges(s, d))[0].select("relative_path", "priority", "degree", "weight")


@query("graph_topk_edges", f"{TOP_CTE} SELECT src, dst FROM e WHERE src IN (SELECT relative_path FROM tn) AND dst IN (SELECT relative_path FROM tn) ORDER BY src, dst LIMIT 220")
def graph_topk_edges(s, d):
    r = _ranked(s, d).withColumn("importance_score", F.round("importance_score", 9))
    return graph.top_graph(r, virtual.edges(s, d))[1].select("src", "dst")


@query("mermaid_export")
def mermaid_export(s, d):
    nodes, edges = graph.top_graph(_ranked(s, d), virtual.edges(s, d))
    return graph.mermaid(cut(nodes), cut(edges))


@query("file_tree", """WITH p AS (SELECT DISTINCT repo, relative_path, string_split(replace(relative_path, chr(92), '/'), '/') AS parts FROM source_files), q AS (SELECT DISTINCT repo, parts FROM p)
    SELECT repo, array_to_string(parts[1:i], '/') AS path, array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name, i::INT AS depth, bool_or(i = len(parts)) AS is_file, count(*) AS n_files FROM q, unnest(range(1, len(parts) + 1)) AS u(i) GROUP BY ALL""")  # fmt: skip
def file_tree(s, d):
    return graph.file_tree(_sources(s, d).select("repo", "relative_path"), ["repo"])


# ---- ranking -------------------------------------------------------------------


@query("lexical_score", f"{WITH_V}, {DUCK_LEX} SELECT relative_path, s AS lexical_score FROM lx")
def lexical_score(s, d):
    return rank.scored(_v(s, d), virtual.words()).select("relative_path", "lexical_score")


@query("importance", f"{WITH_RANK} SELECT relative_path, round(x, 6) AS importance_score FROM s3")
def importance(s, d):
    f = rank.features(_v(s, d).select("relative_path", "text", "scan_ord"), virtual.edges(s, d), [], virtual.words())
    return f.select("relative_path", F.round("importance_score", 6).alias("importance_score"))


@query("flagship_rank", f"{WITH_RANK} SELECT relative_path, priority, s AS lexical_score, d AS graph_distance, round(c, 6) AS centrality, round(x, 6) AS importance_score FROM rk")
def flagship_rank(s, d):
    return rank.ranked(_v(s, d).select("relative_path", "text", "scan_ord"), virtual.edges(s, d), [], virtual.words()).select("relative_path", "priority", "lexical_score", "graph_distance", F.round("centrality", 6).alias("centrality"), F.round("importance_score", 6).alias("importance_score"))


@query("priority_counts", f"{WITH_RANK} SELECT priority, count(*) AS n_files FROM rk GROUP BY priority")
def priority_counts(s, d):
    return _ranked(s, d).groupBy("priority").agg(F.count("*").alias("n_files"))


ORD = "CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, coalesce(d, 99), round(x, 9) DESC, s DESC, relative_path"


@query("rank_order", f"{WITH_RANK} SELECT relative_path, row_number() OVER (ORDER BY {ORD}) AS rank_ord FROM rk")
def rank_order(s, d):
    r = _ranked(s, d).withColumn("importance_score", F.round("importance_score", 9))
    return running.running(r.select("relative_path", "priority", "graph_distance", "importance_score", "lexical_score"), [], rank.rank_order()).select("relative_path", "rank_ord")


@query("running_bytes", f"{WITH_RANK} SELECT relative_path, sum(n_bytes) OVER (ORDER BY {ORD} ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes_so_far FROM rk")
def running_bytes(s, d):
    r = _ranked(s, d).withColumn("importance_score", F.round("importance_score", 9))
    cols = r.select("relative_path", "priority", "graph_distance", "importance_score", "lexical_score", "n_bytes")
    return running.running(cols, [], rank.rank_order(), {"bytes_so_far": F.col("n_bytes")}).select("relative_path", F.col("bytes_so_far").cast("long").alias("bytes_so_far"))


CODES = f"""concat_ws(' ', CASE WHEN s > 0 THEN 'TASK_MATCH' END, CASE WHEN c >= 0.25 THEN 'CORE_ARCH' END, CASE WHEN d IS NOT NULL THEN 'GRAPH_DISTANCE' END, CASE WHEN {ANDROID} THEN 'ANDROID_SOURCE' WHEN cat = 'source_code' THEN 'SOURCE_FILE' END,
    CASE WHEN {ENTRY} THEN 'ENTRY_POINT' END, CASE WHEN boiler THEN 'BOILERPLATE_PENALTY' END, CASE WHEN cat = 'config_data' THEN 'CONFIG_PRIORITY_CAP' END)"""


@query("reason_codes", f"{WITH_RANK}, k AS (SELECT relative_path, {CODES} AS codes FROM rk) SELECT relative_path, concat(CASE WHEN codes = '' THEN 'BACKGROUND_CONTEXT' ELSE codes END, ' FINAL_SCORE') AS codes FROM k")
def reason_codes(s, d):
    r = _ranked(s, d)
    why = rank.reasons(F.col("lexical_score"), F.col("centrality"), F.col("graph_distance"), F.col("importance_score"), F.col("relative_path"), virtual.words())
    return r.select("relative_path", F.array_join(F.transform(why, lambda x: x["code"]), " ").alias("codes"))


def _message(key: str) -> str:
    q = lambda x: x.replace("'", "''")
    others = " ".join(f"WHEN '{loc}' THEN '{q(known[key])}'" for loc, known in M.MESSAGES.items() if key in known and loc != "en")
    return f"(CASE loc {others} ELSE '{q(M.MESSAGES['en'][key])}' END)" if others else f"'{q(M.MESSAGES['en'][key])}'"


def _filled(key: str, name: str = "", value: str = "") -> str:
    return f"replace({_message(key)}, '{{{name}}}', CAST({value} AS VARCHAR))" if name else _message(key)


REASONS = f"""concat_ws('; ', CASE WHEN s > 0 THEN {_filled('task_match', 'matches', 's')} END, CASE WHEN c >= 0.25 THEN {_filled('core_arch', 'centrality', 'round(c, 3)')} END,
    CASE WHEN d IS NOT NULL THEN {_filled('graph_distance', 'distance', 'd')} END, CASE WHEN {ANDROID} THEN {_filled('android_source')} WHEN cat = 'source_code' THEN {_filled('source_file')} END, CASE WHEN {ENTRY} THEN {_filled('entry_point')} END,
    CASE WHEN boiler THEN {_filled('boilerplate_penalty')} END, CASE WHEN cat = 'config_data' THEN {_filled('config_priority_cap')} END)"""


@query("reason_text", f"""{WITH_RANK}, l(loc) AS (VALUES {', '.join(f"('{x}')" for x in T.LOCALES)}), k AS (SELECT relative_path, loc, x, {REASONS} AS why FROM rk CROSS JOIN l)
    SELECT relative_path, loc, concat(CASE WHEN why = '' THEN {_filled('background_context')} ELSE why END, '; ', {_filled('final_score', 'final_score', 'round(x, 2)')}) AS reason FROM k""")
def reason_text(s, d):
    r = _ranked(s, d)
    why = rank.reasons(F.col("lexical_score"), F.col("centrality"), F.col("graph_distance"), F.col("importance_score"), F.col("relative_path"), virtual.words())
    r = r.withColumn("w", why).select("relative_path", "w").withColumn("loc", F.explode(F.array(*map(F.lit, T.LOCALES))))
    return r.select("relative_path", "loc", render.localized_reason(F.col("w"), F.col("loc")).alias("reason"))


# ---- compression ----------------------------------------------------------------


@query("strip_block_comments", "SELECT file_id, length(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS chars_left FROM source_files WHERE text IS NOT NULL")
def strip_block_comments(s, d):
    return table(s, d, "source_files", "file_id", "text").where("text is not null").select("file_id", F.length(compress.without_blocks(F.col("text"))).alias("chars_left"))


def _code(s, d):
    return _sources(s, d).where("text is not null").select("file_id", "language", "text")


def _masked(x: str) -> str:
    for plain, one in compress._ESCAPES:
        x = f"replace({x}, '{plain.replace(chr(39), chr(39) * 2)}', '{one}')"
    return x


def _unmasked(x: str) -> str:
    for plain, one in reversed(compress._ESCAPES):
        x = f"replace({x}, '{one}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


def _sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


NOT_PYTHON = f"src AS (SELECT file_id, text FROM source_files WHERE text IS NOT NULL AND coalesce(nullif(detected_language, 'unknown'), {lang_sql(NORMP)}) <> 'python')"
_STRIP = _sub(_sub(_sub(_masked(f"replace({_sub('text', compress.BLOCK)}, chr(13) || chr(10), chr(10))"), compress.COMMENT, "\\1"), compress.BLANK_LINES, "\n"), compress.BLANK_ENDS)


def _opens(x: str) -> str:
    return f"contains({_sub(x, compress.OPENING, chr(92) + '1')}, '/*')"


LINE_CTE = f"""{NOT_PYTHON}, ln AS (SELECT file_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT file_id, string_split(replace(text, chr(13) || chr(10), ' ' || chr(10)), chr(10)) AS l FROM src)),
 mk AS (SELECT *, {_masked('line')} AS m, substring({_masked('line')}, instr({_masked('line')}, '*/') + 2) AS rest, contains({_masked('line')}, '*/') AS closes FROM ln),
 st AS (SELECT *, CASE WHEN {_opens('m')} = (NOT closes OR {_opens('rest')}) THEN {_opens('m')} END AS says FROM mk),
 ins AS (SELECT *, coalesce(last_value(says IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM st),
 sh AS (SELECT *, {_sub("CASE WHEN NOT inside THEN m WHEN closes THEN rest ELSE '' END", compress.BLOCK)} AS s FROM ins),
 cd AS (SELECT *, {_sub(_sub("CASE WHEN " + _opens('s') + " THEN " + _sub('s', '(?s)/[*].*') + " ELSE s END", compress.COMMENT, chr(92) + '1'), '[ \\t\\n\\f\\r\\x0b]+\\z')} AS c FROM sh),
 rw AS (SELECT file_id, n, sum(length(line) + 1) OVER w - length(line) - 1 AS place, line, {_unmasked('c')} AS code, {_sub('c', compress.QUOTED)} AS bare FROM cd WINDOW w AS (PARTITION BY file_id ORDER BY n)),
 lr AS (SELECT *, length(bare) - length(replace(bare, chr(123), '')) AS up, length(bare) - length(replace(bare, chr(125), '')) AS down, length(regexp_extract(bare, '^([^{{]*)', 1)) - length(replace(regexp_extract(bare, '^([^{{]*)', 1), chr(125), '')) AS fd FROM rw)"""
KIND = f"CASE WHEN {_is('code', compress.CLASSES)} THEN 'class' WHEN {_is('code', compress.FUNCTIONS)} OR {_is('code', compress.BOUND)} OR ({_is('code', compress.TYPED)} AND NOT {_is('code', compress.CONTROL)}) THEN 'function' END"
SIGN = "rtrim(regexp_extract(code, '^([^{;]*)', 1))"
# A block ends at the first later line that comes down to its level: here by comparing lines, not by levels.
DECL_CTE = f"""{LINE_CTE}, dp AS (SELECT *, sum(up - down) OVER (PARTITION BY file_id ORDER BY n) AS aft, {KIND} AS kind, regexp_matches(lead(code) OVER (PARTITION BY file_id ORDER BY n), '^[ \\t]*[{{]') AS nx FROM lr),
 dl AS (SELECT *, aft - up + down AS bef, least(aft - up + down - fd, aft) AS low FROM dp),
 ds AS (SELECT h.file_id, h.n, h.place, h.kind, h.code, CASE WHEN h.kind = 'function' AND (h.aft > h.bef OR coalesce(h.nx, false)) THEN coalesce((SELECT min(x.n) FROM dl x WHERE x.file_id = h.file_id AND x.n > h.n AND x.low <= h.bef AND x.bef > h.bef), h.n) ELSE h.n END AS last_n FROM dl h WHERE h.kind IS NOT NULL)"""
_PAD = "regexp_extract(code, '^([ \\t]*)', 1)"
SHOWN = f"CASE WHEN regexp_matches(code, ';[ \\t]*$') THEN {SIGN} || ';' WHEN {SIGN} LIKE '%:' THEN {SIGN} || chr(10) || {_PAD} || '  {compress.HIDDEN}' ELSE {SIGN} || ' ' || chr(123) || chr(10) || {_PAD} || '  {compress.HIDDEN}' || chr(10) || {_PAD} || chr(125) END"


@query("strip_comments", f"WITH {NOT_PYTHON} SELECT file_id, {_unmasked(_STRIP)} AS code FROM src")
def strip_comments(s, d):
    return _code(s, d).where("language <> 'python'").select("file_id", compress.stripped(F.col("text")).alias("code"))


@query("strip_python")
def strip_python(s, d):
    return _code(s, d).where("language = 'python'").select("file_id", compress.python_parts(F.col("text"))["stripped"].alias("code"))


def _parts(s, d, python: bool | None = None):
    f = _code(s, d)
    return compress.parts(f if python is None else f.where(f"(language = 'python') = {python}"), ["file_id"])


@query("code_lines", f"WITH {LINE_CTE} SELECT file_id, n::INT AS n, place::INT AS place, code, up::INT AS up, down::INT AS down FROM lr")
def code_lines(s, d):
    rows = compress.line_rows(_code(s, d).where("language <> 'python'"), ["file_id"])
    return rows.select("file_id", "n", F.col("place").cast("int").alias("place"), "code", "up", "down")


@query("skeletons", f"""WITH {DECL_CTE}, tw AS (SELECT *, row_number() OVER (PARTITION BY file_id, regexp_replace({SIGN}, '\\s+', ' ', 'g') ORDER BY n) AS k FROM ds)
    SELECT src.file_id, coalesce(string_agg({SHOWN}, chr(10) ORDER BY n), '{compress.HIDDEN}') AS code FROM src LEFT JOIN tw ON tw.file_id = src.file_id AND k = 1 GROUP BY src.file_id""")
def skeletons(s, d):
    return _parts(s, d, False).select("file_id", F.col("skeleton").alias("code"))


@query("skeletons_python")
def skeletons_python(s, d):
    return _parts(s, d, True).select("file_id", F.col("skeleton").alias("code"))


@query("smart_snippets")
def smart_snippets(s, d):
    return _parts(s, d, False).withColumn("pieces", compress.pieces(virtual.words())).select("file_id", compress.snippet(12).alias("code"))


@query("smart_snippets_python")
def smart_snippets_python(s, d):
    return _parts(s, d, True).withColumn("pieces", compress.pieces(virtual.words())).select("file_id", compress.snippet(12).alias("code"))


@query("declarations", f"WITH {DECL_CTE} SELECT ds.file_id, kind, ds.place::INT AS start_offset, (e.place + length(rtrim(e.line)))::INT AS end_offset, ds.n::INT AS start_line, last_n::INT AS end_line, signature FROM (SELECT *, {SIGN} AS signature FROM ds) ds JOIN lr e ON e.file_id = ds.file_id AND e.n = last_n")
def declarations(s, d):
    return compress.declaration_rows(_code(s, d).where("language <> 'python'"), ["file_id"])


@query("declarations_python")
def declarations_python(s, d):
    return compress.declaration_rows(_code(s, d).where("language = 'python'"), ["file_id"])


@query("sift_dispatch")
def sift_dispatch(s, d):
    p = F.element_at(F.array(*map(F.lit, ["HIGH", "MEDIUM", "LOW"])), (F.pmod("file_id", F.lit(3)) + 1).cast("int"))
    return _parts(s, d).withColumn("priority", p).select("file_id", "priority", compress.sifted(F.col("priority"), low_code=False).alias("code"))


# ---- budgets and documents -----------------------------------------------------


@query("included_prefix", f"{WITH_RANK}, o AS (SELECT relative_path, priority, row_number() OVER (PARTITION BY priority ORDER BY {ORD}) AS n FROM rk) SELECT relative_path, priority, n FROM o WHERE (priority = 'HIGH' AND n <= 20) OR (priority = 'MEDIUM' AND n <= 10)")
def included_prefix(s, d):
    r = _ranked(s, d).withColumn("importance_score", F.round("importance_score", 9)).select("relative_path", "priority", "graph_distance", "importance_score", "lexical_score")
    n = running.running(r, ["priority"], rank.rank_order(), number="n")
    return n.where("(priority = 'HIGH' and n <= 20) or (priority = 'MEDIUM' and n <= 10)").select("relative_path", "priority", "n")


def _requests(s, d):
    return table(s, d, "requests", "request_id", "task", "token_limit", "locale")


def _inputs(s, d):
    return table(s, d, "input_files", "request_id", "input_id", "file_ord", "name", "content")


@query("request_corpus", f"""WITH {NORM_CTE}, ok AS (SELECT request_id, coalesce(token_limit, 8000)::BIGINT AS lim FROM requests WHERE trim(task) <> '' AND (token_limit IS NULL OR token_limit BETWEEN 1 AND 1000000))
    SELECT q.request_id, relative_path, lim AS "limit", {lang_sql('relative_path')} AS language FROM q JOIN ok USING (request_id) WHERE NOT {IGP}""")  # fmt: skip
def request_corpus(s, d):
    return context.request_corpus(_inputs(s, d), _requests(s, d)).select("request_id", "relative_path", F.col("limit").cast("long").alias("limit"), "language")


@query("request_ranks")
def request_ranks(s, d):
    return context.ranked_files(context.request_corpus(_inputs(s, d), _requests(s, d)))[0].select("request_id", "relative_path", "priority", "rank_ord", "reason", "summary")


@query("budget_attempts")
def budget_attempts(s, d):
    return context.build(_inputs(s, d), _requests(s, d)).attempts


@query("budget_choice")
def budget_choice(s, d):
    return context.build(_inputs(s, d), _requests(s, d)).choice


@query("render_documents")
def render_documents(s, d):
    return context.build(_inputs(s, d), _requests(s, d)).documents


_VIRTUAL = {"py": "python", "ts": "javascript", "kt": "dotted", "go": "go"}
_STEM = f"translate(regexp_replace({NAME.format(p='relative_path')}, '[.][^.]+$', ''), '_-', '  ')"


@query("low_summaries", f"""{WITH_RANK}, im AS (SELECT relative_path, list_sort(list_distinct(CASE {' '.join(f"WHEN relative_path LIKE '%.{e}' THEN {_extract(n)}" for e, n in _VIRTUAL.items())} ELSE [] END)) AS i FROM v)
    SELECT relative_path, concat('- `', relative_path, '`: ', {_STEM}, CASE WHEN len(i) > 0 THEN concat('; imports ', array_to_string(i[1:3], ', ')) ELSE ' source file' END, '.') AS line FROM rk JOIN im USING (relative_path) WHERE priority <> 'HIGH'""")
def low_summaries(s, d):
    f = virtual.found(s, d).groupBy(F.col("src").alias("relative_path")).agg(F.collect_set("import_name").alias("i"))
    # MEDIUM files too: few are LOW, and the line is made alike.
    r = _ranked(s, d).where("priority <> 'HIGH'").join(f, "relative_path", "left")
    return r.select("relative_path", F.concat(F.lit("- `"), "relative_path", F.lit("`: "), T.summary("relative_path", F.col("i")), F.lit(".")).alias("line"))


# ---- reports -------------------------------------------------------------------


@query("files_scanned", f"SELECT repo, count(*) AS files_scanned, count(text) AS with_text, sum(length(text))::BIGINT AS chars, {' , '.join(f'count(*) FILTER (WHERE {cat_sql(NORMP)} = {chr(39)}{c}{chr(39)}) AS {c}' for c in ('source_code', 'config_data', 'asset'))} FROM source_files GROUP BY repo")
def files_scanned(s, d):
    cat = C.category_of("relative_path")
    return _sources(s, d).groupBy("repo").agg(F.count("*").alias("files_scanned"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"), *[F.count(F.when(cat == c, 1)).alias(c) for c in ("source_code", "config_data", "asset")])


@query("response_counts", "SELECT response_id, CAST(coalesce(priority_counts['HIGH'], 0) AS BIGINT) AS high, CAST(coalesce(priority_counts['MEDIUM'], 0) AS BIGINT) AS medium, CAST(coalesce(priority_counts['LOW'], 0) AS BIGINT) AS low, coalesce(tokens, 0)::BIGINT AS tokens FROM sift_responses")
def response_counts(s, d):
    r = table(s, d, "sift_responses", "response_id", "priority_counts", "tokens")
    n = lambda k: F.coalesce(F.try_element_at("priority_counts", F.lit(k)), F.lit(0)).cast("long").alias(k.lower())
    return r.select("response_id", n("HIGH"), n("MEDIUM"), n("LOW"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@query("token_savings", """WITH c AS (SELECT request_id, sum(length(content) + length(regexp_replace(content, '[\\x{0}-\\x{FFFF}]', '', 'g')))::BIGINT AS chars FROM input_files GROUP BY request_id),
    t AS (SELECT response_id, coalesce(tokens, 0)::BIGINT AS o, greatest(coalesce(tokens, 0), ceil(coalesce(chars, 0) / 4))::BIGINT AS original_tokens FROM sift_responses LEFT JOIN c USING (request_id))
    SELECT response_id, original_tokens, original_tokens - o AS saved_tokens, round((original_tokens - o) * 0.000015, 6) AS saved_cost, CASE WHEN original_tokens > 0 THEN greatest(0, round((1 - o / original_tokens) * 100))::BIGINT ELSE 0 END AS saved_percent FROM t""")  # fmt: skip
def token_savings(s, d):
    c = table(s, d, "input_files", "request_id", "content").groupBy("request_id").agg(F.sum(report.utf16_length(F.col("content"))).alias("chars"))
    r = table(s, d, "sift_responses", "response_id", "request_id", "tokens").join(c, "request_id", "left")
    out = r.select("response_id", *report.savings(F.coalesce("chars", F.lit(0)), F.coalesce("tokens", F.lit(0)).cast("long")))
    return out.withColumn("saved_cost", F.round("saved_cost", 6))


@query("file_type_histogram", f"""WITH x AS (SELECT repo, coalesce(nullif({SUF.format(p=NORMP)}, ''), 'none') AS ext, count(*) AS n, min(file_id) AS f FROM source_files GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, f) AS r FROM x)
    SELECT repo, string_agg(concat(ext, ':', n), ', ' ORDER BY r) AS types FROM k WHERE r <= 8 GROUP BY repo""")  # fmt: skip
def file_type_histogram(s, d):
    return report.file_types(_sources(s, d).select("repo", "relative_path", "file_id"), ["repo"], "relative_path", "file_id")


@query("parse_blocks", r"""WITH p AS (SELECT response_id, unnest(string_split(markdown, '#### `')[2:]) AS part FROM sift_responses WHERE markdown IS NOT NULL),
    b AS (SELECT response_id, regexp_extract(part, '(?s)^([^`\n]+)`\n.*?```([\w+#-]*)\n(.*?)\n```', ['path', 'language', 'content']) AS x FROM p) SELECT response_id, x.path AS path, x.language AS language, x.content AS content FROM b WHERE x.path <> ''""")
def parse_blocks(s, d):
    return report.blocks(table(s, d, "sift_responses", "response_id", "markdown"), "response_id", "markdown").drop("ord")


@query("block_headings", "SELECT response_id, len(regexp_extract_all(markdown, '#### `([^`\\n]+)`', 1))::BIGINT AS n_files, coalesce(array_to_string(regexp_extract_all(markdown, '#### `([^`\\n]+)`', 1), ' '), '') AS paths FROM sift_responses WHERE markdown IS NOT NULL")
def block_headings(s, d):
    r = table(s, d, "sift_responses", "response_id", "markdown").where("markdown is not null")
    p = F.regexp_extract_all("markdown", F.lit(r"#### `([^`\n]+)`"), F.lit(1))
    return r.select("response_id", F.size(p).cast("long").alias("n_files"), F.array_join(p, " ").alias("paths"))


LINES = "SELECT repo, name, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT repo, name, string_split(text, chr(10)) AS l FROM {t})"


@query("line_diff", f"""WITH o AS (SELECT repo, name, arg_min(content, input_id) AS text FROM input_files WHERE content IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2), w AS (SELECT repo, name, arg_max(content, input_id) AS text FROM input_files WHERE content IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
    ol AS ({LINES.format(t="o WHERE text <> ''")}), wl AS ({LINES.format(t='w')}), j AS (SELECT wl.repo, wl.name, wl.i, (o.text <> '') AND wl.t <> coalesce(ol.t, '') AS changed FROM wl JOIN o USING (repo, name) LEFT JOIN ol USING (repo, name, i))
    SELECT repo, name, count(*) AS n_lines, count(*) FILTER (WHERE changed) AS n_changed FROM j GROUP BY repo, name""")  # fmt: skip
def line_diff(s, d):
    f = table(s, d, "input_files", "repo", "name", "input_id", "content").where("content is not null and name is not null")
    ends = f.groupBy("repo", "name").agg(F.min_by("content", "input_id").alias("a"), F.max_by("content", "input_id").alias("b"))
    ends = cut(ends)
    changed = report.line_changes(ends.select("repo", "name", F.col("a").alias("text")), ends.select("repo", "name", F.col("b").alias("text")), ["repo", "name"])
    return changed.groupBy("repo", "name").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("changed"), 1)).alias("n_changed"))


@query("can_submit", """SELECT r.request_id, coalesce(bool_or(trim(content) <> ''), false) AND coalesce(trim(any_value(task)), '') <> '' AS ok FROM requests r LEFT JOIN input_files f USING (request_id) GROUP BY r.request_id""")
def can_submit(s, d):
    f = table(s, d, "input_files", "request_id", "content").groupBy("request_id").agg(F.bool_or(F.trim("content") != "").alias("_any"))
    r = _requests(s, d).join(f, "request_id", "left")
    return r.select("request_id", (F.coalesce("_any", F.lit(False)) & (F.coalesce(F.trim("task"), F.lit("")) != "")).alias("ok"))


@query("response_json", """SELECT request_id, markdown, tokens::INT AS tokens, files_scanned::BIGINT AS files_scanned, CAST(priority_counts['HIGH'] AS BIGINT) AS high, compression_warning FROM sift_responses""")
def response_json(s, d):
    r = table(s, d, "sift_responses", "request_id", "markdown", "tokens", "files_scanned", "priority_counts", "compression_warning")
    back = report.from_response(report.to_response(r))
    return back.withColumn("high", F.try_element_at("priority_counts", F.lit("HIGH"))).drop("priority_counts")


@query("markdown_files", "SELECT response_id::BIGINT AS response_id, length(markdown) AS chars FROM sift_responses WHERE markdown IS NOT NULL")
def markdown_files(s, d):
    at = f"{shared_dir(s)}/markdown-{uuid.uuid4().hex}"
    render.write_markdown(table(s, d, "sift_responses", "response_id", "markdown"), at, "response_id")
    removed_at_end(s, at)
    return render.read_markdown(s, at, "response_id").select(F.col("response_id").cast("long").alias("response_id"), F.length("markdown").alias("chars"))


@query("result_rows")
def result_rows(s, d):
    return context.build(_inputs(s, d), _requests(s, d)).results()


@query("result_metrics")
def result_metrics(s, d):
    return context.build(_inputs(s, d), _requests(s, d)).metrics()


@query("priority_groups")
def priority_groups(s, d):
    corpus = context.request_corpus(_inputs(s, d), _requests(s, d))
    ids = ["request_id", "relative_path"]
    return render.groups(context.ranked_files(corpus)[0].join(compress.parts(corpus, ids), ids, "left"))


# ---- jobs ----------------------------------------------------------------------

CLEAN = "c AS (SELECT min(event_id) AS event_id FROM job_events GROUP BY job_id, ts, lower(trim(status))), j AS (SELECT event_id, job_id, ts, lower(trim(status)) AS status, greatest(0, least(100, progress))::INT AS progress, message, message_code, result_json, error FROM job_events WHERE event_id IN (SELECT event_id FROM c))"
LATEST = f"{CLEAN}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k, last_value(result_json IGNORE NULLS) OVER w AS r, last_value(error IGNORE NULLS) OVER w AS er, max(ts) OVER (PARTITION BY job_id) AS up FROM j WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), l AS (SELECT * FROM n WHERE k = 1)"
# The end of the test period: job times are judged against it, not against a clock.
NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _events(s, d):
    return table(s, d, "job_events")


@query("job_create", "SELECT concat('job-', request_id) AS job_id, request_id, epoch_us(created_at) AS created_us, 'queued' AS status, 0 AS progress, 'jobQueued' AS message_code FROM requests")
def job_create(s, d):
    r = jobs.created(table(s, d, "requests", "request_id", "created_at"))
    return r.select("job_id", "request_id", F.unix_micros("ts").alias("created_us"), "status", "progress", "message_code")


@query("job_latest_state", f"WITH {LATEST} SELECT job_id, status, progress, message_code, epoch_us(ts) AS updated_us FROM l")
def job_latest_state(s, d):
    return jobs.latest(_events(s, d)).select("job_id", "status", "progress", "message_code", F.unix_micros("updated_at").alias("updated_us"))


@query("job_coalesce_fold", f"WITH {LATEST} SELECT job_id, status, r AS result_json, er AS error FROM l")
def job_coalesce_fold(s, d):
    return jobs.latest(_events(s, d)).select("job_id", "status", "result_json", "error")


@query("job_stale_expiry", f"WITH {LATEST} SELECT job_id, CASE WHEN status IN ('queued', 'running') AND up < {NOW} - INTERVAL 300 SECOND THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') AND up < {NOW} - INTERVAL 300 SECOND THEN 100 ELSE progress END AS progress FROM l")
def job_stale_expiry(s, d):
    return jobs.expired(jobs.latest(_events(s, d)), F.expr(NOW)).select("job_id", "status", "progress")


@query("job_restart_recovery", f"WITH {LATEST} SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, count(*) AS n_jobs FROM l GROUP BY 1")
def job_restart_recovery(s, d):
    return jobs.interrupted(jobs.latest(_events(s, d)), F.expr(NOW)).groupBy("status").agg(F.count("*").alias("n_jobs"))


SNAP = "{{'a': status, 'b': progress, 'c': message, 'd': message_code, 'e': result_json, 'f': error}}".replace("{{", "{").replace("}}", "}")


@query("job_emissions", f"""WITH {CLEAN}, x AS (SELECT *, {SNAP} AS sn, lag({SNAP}) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k,
    coalesce(sum((status IN ('completed', 'failed'))::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM j)
    SELECT job_id, event_id, CASE status WHEN 'completed' THEN 'result' WHEN 'failed' THEN 'error' ELSE 'progress' END AS event, status, progress, message_code FROM x WHERE ended = 0 AND (k = 1 OR b IS DISTINCT FROM sn)""")  # fmt: skip
def job_emissions(s, d):
    return jobs.emissions(_events(s, d)).drop("ts")


@query("job_gap_sessions", f"""WITH {CLEAN}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) <= 4000000 THEN 0 ELSE 1 END AS n FROM j),
    h AS (SELECT *, sum(n) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS q FROM g) SELECT job_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n_events FROM h GROUP BY job_id, q""")  # fmt: skip
def job_gap_sessions(s, d):
    return jobs.silences(_events(s, d), 4).select("job_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events")


@query("job_debounced", f"WITH {CLEAN}, g AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) - epoch_us(ts) AS w FROM j) SELECT job_id, event_id, status FROM g WHERE w IS NULL OR w > 450000")
def job_debounced(s, d):
    return jobs.debounced(_events(s, d)).select("job_id", "event_id", "status")


@query("job_stream_state")
def job_stream_state(s, d):
    from ..streaming import jobs as stream

    at = f"{shared_dir(s)}/job-stream-{uuid.uuid4().hex}"
    stream.run_once(stream.read_events(s, d), f"{at}/out", f"{at}/checkpoint")
    out = s.read.parquet(f"{at}/out")
    last = F.max_by(F.struct("status", "progress", "message_code", "result_json", "error", "updated_at"), F.struct("updated_at", "batch"))
    return out.groupBy("job_id").agg(last.alias("l")).select("job_id", "l.*")
