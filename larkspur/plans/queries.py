"""Every operator as a query over the given tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions import outputs, prompts, text
from larkspur.operators import dense, dialogue, embedding_job, evaluation, experiments, indexing, lexical, ports, pruned_dense, storage
from larkspur.operators.impact_index import ImpactIndex
from larkspur.plans import sql as S
from larkspur.plans import standins as I  # noqa: E741
from larkspur.sources import readers, writers
from larkspur.sources import records as record_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def joined(array) -> F.Column:
    return F.array_join(array.cast("array<string>"), "|")


def _sql_joined(array: str) -> str:
    return f"coalesce(array_to_string({array}, '|'), '')"


# --- scans ---


@query("scan_conversations", f"WITH {S.TURNS} SELECT number, title, count(*) AS n_turns, max(oracle) AS last_oracle FROM t GROUP BY number, title")
def scan_conversations(spark, d):
    lines = I.topics(spark, d).select(F.to_json(F.struct("number", "title", "ptkb", "turns")).alias("value"))
    rows = readers.json_rows(lines, schemas.TOPIC)
    return rows.select("number", "title", F.size("turns").cast("long").alias("n_turns"), F.array_max(F.transform("turns", lambda t: t["resolved_utterance"])).alias("last_oracle"))


@query("scan_turns", f"WITH {S.TURNS} SELECT sample_id, title, utt AS cur_utt_text, {_sql_joined('prov')} AS prov FROM t")
def scan_turns(spark, d):
    lines = I.turns(spark, d).select("line_no", F.to_json(F.struct("sample_id", "number", "title", "cur_utt_text", "ptkb", "ptkb_provenance")).alias("value"))
    bad = lines.select("line_no", F.lit("{ broken").alias("value")).unionByName(lines.select("line_no", F.lit("").alias("value")))
    rows = readers.json_rows(lines.unionByName(bad), schemas.FLAT_TURN)
    return rows.select("sample_id", "title", "cur_utt_text", joined(F.col("ptkb_provenance")).alias("prov"))


@query("qrels_assessed_ids", f"WITH {S.TURNS} SELECT qid FROM ids")
def qrels_assessed_ids(spark, d):
    return I.assessed(spark, d)


@query("qrels_binarize", f"WITH {S.JUDGED} SELECT qid, pid, rel, CAST(hit AS BIGINT) AS hit FROM j")
def qrels_binarize(spark, d):
    out = readers.qrels(I.judgement_lines(spark, d))
    return out.select("qid", "pid", F.col("rel").cast("long").alias("rel"), F.col("hit").cast("long").alias("hit"))


@query("run_scan", f"WITH {S.RUN} SELECT qid, pid, round(score, 6) AS score FROM r")
def run_scan(spark, d):
    lines = I.run_lines(spark, d)
    seven = lines.select("line_no", F.regexp_replace("value", r"^(\S+ \S+ \S+ \S+ \S+) x bm25$", "$1 dense").alias("value"))
    return readers.run(seven).select("qid", "pid", F.round("score", 6).alias("score"))


@query("passage_scan_truncate", "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(left(regexp_replace(text, '\\s+$', ''), 10000)) AS contents_sha FROM documents")
def passage_scan_truncate(spark, d):
    lines = I.passages(spark, d).select(F.to_json(F.struct(F.col("pid").alias("id"), F.concat("text", F.lit(" \n")).alias("contents"))).alias("value"))
    lines = lines.unionByName(lines.limit(3).select(F.lit("").alias("value")))
    out = readers.passages_json(lines)
    return out.select("id", F.sha2("contents", 256).alias("contents_sha"))


@query("passage_tsv_title", "SELECT CAST(page_id AS VARCHAR) AS id, 'a b ' || url AS contents FROM pages WHERE page_id % 3 <> 0")
def passage_tsv_title(spark, d):
    page = I.table(spark, d, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit("\ta [SEP] b"))
    return readers.passages_tsv(page.select(F.concat(F.col("page_id").cast("string"), F.lit("\t"), "url", tail).alias("value")), title=True)


@query("token_record_lookup", """WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS pid, doc_id AS "offset", list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: len(w)) AS ids FROM documents)
SELECT pid, "offset", CAST(least(len(ids), 16) AS BIGINT) AS n_tokens, array_to_string(list_resize(ids[1:16], 16, 0), '|') AS token_ids FROM x""")
def token_record_lookup(spark, d):
    records = _records(spark, d, 16)
    out = indexing.lookup_records(records, I.table(spark, d, "documents").select(F.col("doc_id").alias("offset")))
    return out.select("pid", "offset", F.col("n_tokens").cast("long").alias("n_tokens"), joined(F.col("token_ids")).alias("token_ids"))


@query("record_files", """WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS pid, row_number() OVER (ORDER BY doc_id) - 1 AS "offset", list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: len(w)) AS ids FROM documents)
SELECT pid, "offset", CAST(least(len(ids), 64) AS BIGINT) AS n_tokens, array_to_string(list_resize(ids[1:64], 64, 0), '|') AS token_ids FROM x""")
def record_files(spark, d):
    """All records written to binary files in the order of their documents, and read back with the offsets of their places."""
    path = storage.scratch(spark, "records")
    record_store.write(_records(spark, d, 64), path, order="offset")
    return record_store.read(spark, path).select("offset", "pid", F.col("n_tokens").cast("long").alias("n_tokens"), joined(F.col("token_ids")).alias("token_ids"))


def _records(spark, d, length):
    ids = F.transform(text.tokenize(F.col("text")), lambda w: F.length(w))
    rows = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pid"), F.col("doc_id").alias("offset"), ids.alias("ids"))
    return indexing.token_records(rows, length)


@query("embedding_scan", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def embedding_scan(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return I.vectors(spark, d).select("vec_id", F.size("vector").cast("long").alias("width"), F.round(total, 6).alias("total"))


@query("collection_count", "SELECT count(*) AS n_passages FROM documents")
def collection_count(spark, d):
    return I.passages(spark, d).agg(F.count(F.lit(1)).alias("n_passages"))


@query("batch_response_parse", f"WITH {S.TURNS}, {S.ANSWERS} SELECT sample_id AS custom_id, answer AS content FROM a WHERE line_no % 11 NOT IN (1, 2) AND answer <> ''")
def batch_response_parse(spark, d):
    return readers.batch_responses(I.responses(spark, d))


@query("prefix_fraction", f"WITH {S.TURNS} SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY conv_id, turn) AS n, count(*) OVER () AS total FROM t) WHERE n <= CAST(floor(0.3 * total) AS BIGINT)")
def prefix_fraction(spark, d):
    return readers.first_fraction(I.turns(spark, d), 0.3).select("sample_id")


# --- filters, projections, joins ---


@query("filter_assessed", f"WITH {S.TURNS} SELECT sample_id, utt AS cur_utt_text FROM t WHERE sample_id IN (SELECT qid FROM ids)")
def filter_assessed(spark, d):
    return dialogue.assessed(I.turns(spark, d), I.assessed(spark, d)).select("sample_id", "cur_utt_text")


@query("is_relevant_prefix", f"""WITH {S.TURNS}, z AS (SELECT CASE WHEN turn % 2 = 0 THEN sample_id ELSE sample_id || '-' || CAST(turn % 4 AS VARCHAR) END AS qid FROM t UNION ALL SELECT number FROM (SELECT DISTINCT number FROM t))
SELECT qid FROM z WHERE qid IN (SELECT qid FROM ids) OR (CASE WHEN contains(qid, '-') THEN regexp_replace(qid, '-[^-]*$', '') ELSE left(qid, greatest(len(qid) - 1, 0)) END) IN (SELECT qid FROM ids)""")
def is_relevant_prefix(spark, d):
    t = I.turns(spark, d)
    asked = t.select(F.when(F.col("pos") % 2 == 0, F.col("sample_id")).otherwise(F.concat_ws("-", "sample_id", (F.col("pos") % 4).cast("string"))).alias("qid"))
    return dialogue.relevant(asked.unionByName(t.select(F.col("number").alias("qid")).distinct()), I.assessed(spark, d))


@query("resume_anti_join", f"WITH {S.TURNS} SELECT sample_id FROM t WHERE turn % 3 <> 1")
def resume_anti_join(spark, d):
    t = I.turns(spark, d)
    lines = t.filter("pos % 3 = 1").select(F.to_json(F.struct("sample_id")).alias("value")).unionByName(t.filter("pos % 3 = 2").select(F.concat(F.lit('{"sample_id": "'), "sample_id").alias("value")))
    return dialogue.unprocessed(t, readers.json_rows(lines, schemas.FLAT_TURN)).select("sample_id")


@query("subset_filter", f"WITH {S.TURNS} SELECT sample_id AS qid FROM t WHERE len(prov) > 0 AND sample_id IN (SELECT qid FROM ids)")
def subset_filter(spark, d):
    return dialogue.subset(I.turns(spark, d), I.assessed(spark, d), "subset")


_FOLD = f"""WITH RECURSIVE {S.TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t),
fold AS (SELECT conv_id, n, sample_id, prov, prov AS seen, TRUE AS used FROM o WHERE n = 1
  UNION ALL SELECT o.conv_id, o.n, o.sample_id, o.prov, CASE WHEN list_has_any(fold.seen, o.prov) THEN fold.seen ELSE list_concat(fold.seen, o.prov) END, NOT list_has_any(fold.seen, o.prov) FROM fold JOIN o ON o.conv_id = fold.conv_id AND o.n = fold.n + 1)
SELECT sample_id FROM fold WHERE used AND len(prov) > 0 AND sample_id IN (SELECT qid FROM ids)"""


@query("corrected_subset", _FOLD)
def corrected_subset(spark, d):
    return dialogue.corrected_subset(I.turns(spark, d), I.assessed(spark, d))


@query("subset_dispatch", _FOLD.replace("\nSELECT sample_id FROM fold", ",\ncorrected AS (SELECT sample_id FROM fold") + """)
SELECT 'full' AS kind, count(*) AS n FROM ids UNION ALL SELECT 'subset', count(*) FROM t WHERE len(prov) > 0 AND sample_id IN (SELECT qid FROM ids) UNION ALL SELECT 'corrected', count(*) FROM corrected""")
def subset_dispatch(spark, d):
    t, ids = I.turns(spark, d), I.assessed(spark, d)
    parts = [dialogue.subset(t, ids, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("full", "subset", "corrected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FLAT = "sample_id, number, title, utt AS cur_utt_text, oracle AS oracle_utt_text, resp AS cur_response_text"


@query("flatten_turns", f"WITH {S.TURNS} SELECT {_FLAT}, {_sql_joined('prov')} AS prov FROM t")
def flatten_turns(spark, d):
    return dialogue.flatten(I.topics(spark, d)).select("sample_id", "number", "title", "cur_utt_text", "oracle_utt_text", "cur_response_text", joined(F.col("ptkb_provenance")).alias("prov"))


@query("flatten_ptkb_only", f"WITH {S.TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM t) SELECT sample_id, before AS n_context FROM c WHERE len(prov) > 0")
def flatten_ptkb_only(spark, d):
    return dialogue.flatten(I.topics(spark, d), only_facts=True).select("sample_id", F.size("ctx_utts_text").cast("long").alias("n_context"))


@query("context_window", f"""WITH {S.TURNS} SELECT sample_id, coalesce(string_agg(utt, ' // ') OVER w, '') AS questions, coalesce(string_agg(resp, ' // ') OVER w, '') AS answers FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def context_window(spark, d):
    return I.turns(spark, d).select("sample_id", F.array_join("ctx_utts_text", " // ").alias("questions"), F.array_join("history_response", " // ").alias("answers"))


@query("registry_filter", f"WITH {S.TURNS} SELECT 'batch_SAR_' || CAST(turn AS VARCHAR) || 'shot_run' || number || '.jsonl' AS filename, sample_id AS batch_id FROM t WHERE contains('batch_SAR_' || CAST(turn AS VARCHAR) || 'shot_run' || number || '.jsonl', 'SAR_5shot')")
def registry_filter(spark, d):
    t = I.turns(spark, d)
    rows = t.select(F.concat(F.lit("batch_SAR_"), F.col("pos").cast("string"), F.lit("shot_run"), "number", F.lit(".jsonl")).alias("filename"), F.col("sample_id").alias("batch_id"))
    return ports.matching(rows, "SAR_5shot")


@query("provenance_by_annotation", f"""WITH {S.TURNS}, {S.SELECTIONS} SELECT 'LLM' AS kind, sample_id, {_sql_joined("regexp_extract_all(chosen, '[0-9]+')")} AS provenance FROM s
UNION ALL SELECT 'None', sample_id, '' FROM s UNION ALL SELECT 'All', sample_id, '0|1|2|3|4' FROM s UNION ALL SELECT 'human', sample_id, {_sql_joined('prov')} FROM s""")
def provenance_by_annotation(spark, d):
    rows = I.selections(spark, d)
    parts = [dialogue.provenance(rows, k).select(F.lit(k).alias("kind"), "sample_id", joined(F.col("provenance")).alias("provenance")) for k in ("LLM", "None", "All", "human")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("join_provenance", f"WITH {S.TURNS}, {S.SELECTIONS} SELECT sample_id, CASE WHEN turn % 2 = 0 THEN {_sql_joined('''regexp_extract_all(chosen, '[0-9]+')''')} ELSE '' END AS provenance FROM s")
def join_provenance(spark, d):
    rows = I.selections(spark, d)
    out = dialogue.join_provenance(rows, dialogue.provenance(rows.filter("pos % 2 = 0"), "LLM"))
    return out.select("sample_id", joined(F.col("provenance")).alias("provenance"))


@query("extract_numbers", f"WITH {S.TURNS}, {S.SELECTIONS} SELECT sample_id, {_sql_joined('''regexp_extract_all(chosen, '[0-9]+')''')} AS numbers FROM s")
def extract_numbers(spark, d):
    return I.selections(spark, d).select("sample_id", joined(text.extract_numbers(F.col("LLM_select"))).alias("numbers"))


_LOOKUP = f"WITH {S.TURNS}, {S.FACTS}, {S.LABELS}"


@query("ptkb_lookup", f"""WITH {S.TURNS}, {S.FACTS} SELECT t.sample_id, coalesce(string_agg(f.fact, '|' ORDER BY u.pos), '') AS facts FROM t LEFT JOIN (SELECT sample_id, unnest(prov) AS item, generate_subscripts(prov, 1) AS pos FROM t) u USING (sample_id)
LEFT JOIN f ON f.number = t.number AND f.idx = CAST(u.item AS VARCHAR) AND f.fact <> '' GROUP BY t.sample_id""")
def ptkb_lookup(spark, d):
    return I.turns(spark, d).select("sample_id", F.array_join(dialogue.lookup(F.col("ptkb_provenance"), F.col("ptkb")), "|").alias("facts"))


@query("ptkb_label", f"{_LOOKUP} SELECT sample_id, label FROM l")
def ptkb_label(spark, d):
    return I.turns(spark, d).select("sample_id", prompts.label(dialogue.lookup(F.col("ptkb_provenance"), F.col("ptkb"))).alias("label"))


@query("ptkb_explode", f"WITH {S.TURNS}, {S.FACTS} SELECT t.sample_id || '-' || f.idx AS sample_id, f.idx AS ptkb_num, f.fact FROM t JOIN f USING (number)")
def ptkb_explode(spark, d):
    return dialogue.explode_facts(I.turns(spark, d)).select("sample_id", "ptkb_num", "fact")


@query("qid_split", f"WITH {S.TURNS} SELECT sample_id AS qid, number AS base, CAST(turn + 1 AS VARCHAR) AS last FROM t")
def qid_split(spark, d):
    return I.turns(spark, d).select(F.col("sample_id").alias("qid"), text.base_id(F.col("sample_id")).alias("base"), text.last_segment(F.col("sample_id")).alias("last"))


# --- parsing of answers, splitting, query builders ---


def _found(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(answer, '{pattern}', 's') THEN regexp_extract(answer, '{pattern}', 1, 's') END"


def _strip(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


_P = {name: getattr(outputs, name).removeprefix("(?s)") for name in ("QUERIES", "RESPONSE_BEFORE_QUERIES", "REWRITE", "REWRITE_RAW", "REWRITE_LINE", "RESPONSE", "PROVENANCE", "PROVENANCE_LINE")}


def _parsed(fields: dict[str, str]) -> str:
    inner = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return f"WITH {S.TURNS}, {S.ANSWERS} SELECT * FROM (SELECT sample_id, {inner} FROM a) WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in fields)


def _parse(spark, d, value):
    return I.answers(spark, d).select("sample_id", value.alias("p")).filter("p is not null").select("sample_id", "p.*")


@query("parse_prompt1", _parsed({"rewrite": _strip(_found(_P["QUERIES"])), "response": _strip(_found(_P["RESPONSE_BEFORE_QUERIES"]))}))
def parse_prompt1(spark, d):
    return _parse(spark, d, outputs.parse_prompt1(F.col("answer")))


@query("parse_prompt2", _parsed({"rewrite": _strip(_found(_P["REWRITE"])), "response": _strip(_found(_P["RESPONSE"]))}))
def parse_prompt2(spark, d):
    return _parse(spark, d, outputs.parse_prompt2(F.col("answer")))


@query("parse_sar", _parsed({"rewrite": _found(_P["REWRITE_RAW"]), "response": _found(_P["RESPONSE"])}))
def parse_sar(spark, d):
    return _parse(spark, d, outputs.parse_sar(F.col("answer")))


@query("parse_sar_batch", _parsed({"provenance": _strip(_found(_P["PROVENANCE_LINE"])), "rewrite": _strip(_found(_P["REWRITE_LINE"])), "response": _strip(_found(_P["RESPONSE"]))}))
def parse_sar_batch(spark, d):
    return _parse(spark, d, outputs.parse_sar_batch(F.col("answer")))


@query("parse_automatic", _parsed({"rewrite": _strip(_found(_P["REWRITE_LINE"])), "response": _strip(_found(_P["RESPONSE"]))}))
def parse_automatic(spark, d):
    return _parse(spark, d, outputs.parse_automatic(F.col("answer"), batch=True))


@query("parse_selection", f"WITH {S.TURNS}, {S.ANSWERS} SELECT sample_id, coalesce({_strip(_found(_P['PROVENANCE']))}, 'None') AS online, {_strip(_found(_P['PROVENANCE']))} AS batch FROM a")
def parse_selection(spark, d):
    return I.answers(spark, d).select("sample_id", outputs.parse_selection(F.col("answer")).alias("online"), outputs.parse_selection(F.col("answer"), batch=True).alias("batch"))


@query("split_rewrite", f"""WITH {S.TURNS}, {S.REWRITES}, p AS (SELECT sample_id, replace(regexp_replace(translate(rewrite, '"“”', ''), '\\d+\\.\\s*', '', 'g'), chr(10), ', ') AS x FROM w),
pieces AS (SELECT sample_id, list_filter(list_transform(CASE WHEN contains(x, '?') THEN regexp_split_to_array(x, '\\?,?\\s*') ELSE string_split(x, ',') END, lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> '') AS q, contains(x, '?') AS asked FROM p),
u AS (SELECT sample_id, CASE WHEN asked THEN y || '?' ELSE y END AS sub, n FROM (SELECT sample_id, asked, unnest(q) AS y, generate_subscripts(q, 1) AS n FROM pieces)),
once AS (SELECT sample_id, sub, min(n) AS n FROM u GROUP BY ALL)
SELECT sample_id, position, sub AS sub_query FROM (SELECT sample_id, sub, row_number() OVER (PARTITION BY sample_id ORDER BY n) AS position FROM once) WHERE position <= 5""")
def split_rewrite(spark, d):
    rows = I.rewrites(spark, d).select("sample_id", F.posexplode(text.split_rewrite(F.col("rewrite_utt_text"))).alias("position", "sub_query"))
    return rows.select("sample_id", (F.col("position") + 1).cast("long").alias("position"), "sub_query")


_BUILD = f"WITH {S.TURNS}, {S.REWRITES} SELECT sample_id AS qid, "
_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
for _kind, _sql in (
    ("rewrite", "rewrite AS query FROM w"),
    ("concat", "repeat(rewrite, 2) || resp AS query FROM w"),
    ("concat_auto", f"repeat(rewrite, CAST(round_even({_WORDS.format('resp')}::DOUBLE / {_WORDS.format('rewrite')}::DOUBLE / 2.0, 0) AS BIGINT)) || resp AS query FROM w WHERE {_WORDS.format('rewrite')} > 0"),
    ("oracle", "oracle AS query FROM w"),
    ("response", "resp AS query FROM w"),
    ("fusion", "utt || ' | ' || sample_id AS query FROM w"),
):
    query(f"query_build_{_kind}", _BUILD + _sql)(lambda spark, d, kind=_kind: lexical.build_queries(I.rewrites(spark, d), kind, repeats=2, c=2.0))


# --- prompts ---


def _prompt_inputs(spark, d):
    t = I.turns(spark, d)
    return t.select("sample_id", "ptkb", F.col("cur_utt_text").alias("question"), prompts.history(F.col("ctx_utts_text"), F.col("history_response")).alias("past"), prompts.label(dialogue.lookup(F.col("ptkb_provenance"), F.col("ptkb"))).alias("label"), dialogue.facts(F.col("ptkb")).alias("facts"))


_PROMPTS = f"WITH {S.TURNS}, {S.FACTS}, {S.HISTORY}, {S.LABELS}, {S.DICTS} SELECT t.sample_id, "
_FROM = " AS prompt FROM t JOIN h USING (sample_id) JOIN l USING (sample_id) JOIN x USING (number)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("prompt_history", f"WITH {S.TURNS}, {S.HISTORY} SELECT sample_id, past FROM h")
def prompt_history(spark, d):
    return _prompt_inputs(spark, d).select("sample_id", "past")


@query("prompt_select", _PROMPTS + f"{_lit(prompts.SELECT_INTRO)} || {_lit(prompts.EXAMPLES)} || ' ' || 'demo' || chr(10) || chr(10) || {_lit(prompts.TASK_SELECT)} || shown || chr(10) || chr(10) || past || 'Question: ' || utt || chr(10) || chr(10) || {_lit(prompts.SELECT_END)}" + _FROM)
def prompt_select(spark, d):
    return _prompt_inputs(spark, d).select("sample_id", prompts.select(F.col("facts"), F.col("past"), F.col("question"), "demo").alias("prompt"))


@query("prompt_reformulate_p1", _PROMPTS + f"{_lit(prompts.P1_START)} || label || chr(10) || ' ### Conversation: ' || chr(10) || past || 'Current Question: ' || utt || {_lit(prompts.P1_END)}" + _FROM)
def prompt_reformulate_p1(spark, d):
    return _prompt_inputs(spark, d).select("sample_id", prompts.reformulate(1, F.col("label"), F.col("past"), F.col("question")).alias("prompt"))


@query("prompt_reformulate_p2", _PROMPTS + f"{_lit(prompts.REWRITE_INTRO + prompts.P2_USE)} || label || chr(10) || past || 'Current Question: ' || utt || chr(10) || {_lit(prompts.ANSWER_REWRITE)}" + _FROM)
def prompt_reformulate_p2(spark, d):
    return _prompt_inputs(spark, d).select("sample_id", prompts.reformulate(2, F.col("label"), F.col("past"), F.col("question")).alias("prompt"))


@query("prompt_sar", _PROMPTS + f"{_lit(prompts.REWRITE_INTRO + prompts.SAR_USE)} || {_lit(prompts.TASK_SAR)} || shown || chr(10) || chr(10) || past || 'Question: ' || utt || chr(10) || chr(10) || {_lit(prompts.ANSWER_SAR)}" + _FROM)
def prompt_sar(spark, d):
    return _prompt_inputs(spark, d).select("sample_id", prompts.select_and_reformulate(F.col("facts"), F.col("past"), F.col("question")).alias("prompt"))


@query("prompt_automatic", f"WITH {S.TURNS}, {S.FACTS}, {S.HISTORY} SELECT t.sample_id || '-' || idx AS sample_id, {_lit(prompts.AUTOMATIC_INTRO + prompts.TASK_AUTOMATIC)} || fact || chr(10) || chr(10) || past || 'Current Question: ' || utt || chr(10) || chr(10) || {_lit(prompts.ANSWER_REWRITE)} AS prompt FROM t JOIN h USING (sample_id) JOIN f USING (number)")
def prompt_automatic(spark, d):
    rows = dialogue.explode_facts(_prompt_inputs(spark, d))
    return rows.select("sample_id", prompts.automatic(F.col("fact"), F.col("past"), F.col("question")).alias("prompt"))


@query("batch_request_json", f"""WITH {S.TURNS} SELECT sample_id AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'gpt-4o-mini' AS model, {_lit(prompts.SYSTEM_BATCH)} AS system, utt AS content FROM t""")
def batch_request_json(spark, d):
    rows = ports.batch_requests(I.turns(spark, d).select(F.col("sample_id").alias("custom_id"), F.col("cur_utt_text").alias("prompt")), "gpt-4o-mini", prompts.SYSTEM_BATCH)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    back = readers.json_rows(lines, "custom_id string, method string, url string, body struct<model:string,messages:array<struct<role:string,content:string>>>")
    message = lambda i: F.get("body.messages", F.lit(i))["content"]
    return back.select("custom_id", "method", "url", F.col("body.model").alias("model"), message(0).alias("system"), message(1).alias("content"))


_EXAMPLE = """SELECT row_number() OVER (ORDER BY CAST(number AS BIGINT)) AS position, '# Example ' || CAST(row_number() OVER (ORDER BY CAST(number AS BIGINT)) AS VARCHAR) || chr(10) || chr(10) || 'User''s information: ' || shown || chr(10) || chr(10) || body AS text FROM (
SELECT number, any_value(shown) AS shown, string_agg('Question: ' || utt || chr(10) || 'provenance: [' || coalesce(array_to_string(prov, ', '), '') || ']' || chr(10) || 'Rewrite: ' || oracle || chr(10) || 'Response: ' || resp || chr(10) || chr(10), '' ORDER BY turn) AS body FROM t JOIN x USING (number) WHERE number IN ('1', '2', '7') GROUP BY number)"""


@query("fewshot_examples", f"WITH {S.TURNS}, {S.FACTS}, {S.DICTS} {_EXAMPLE}")
def fewshot_examples(spark, d):
    return dialogue.few_shot(I.topics(spark, d), ["1", "2", "7"]).select(F.col("position").cast("long").alias("position"), "text")


@query("fewshot_random", "SELECT number FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS number FROM conversations) ORDER BY md5(number || ':42'), number LIMIT 5")
def fewshot_random(spark, d):
    return dialogue.random_numbers(I.topics(spark, d), 5, 42)


# --- retrieval ---


@query("tokenize", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens"))


@query("bm25_postings", f"WITH {S.ALL_TERMS} SELECT pid, term, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM tf JOIN dls USING (pid)")
def bm25_postings(spark, d):
    return lexical.postings(I.passages(spark, d)).select("pid", "term", "tf", F.col("dl").cast("long").alias("dl"))


@query("bm25_term_stats", f"WITH {S.ALL_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def bm25_term_stats(spark, d):
    return lexical.term_statistics(lexical.postings(I.passages(spark, d)))


@query("bm25_topk", f"WITH {S.BM25} SELECT qid, pid, score, rank FROM bm")
def bm25_topk(spark, d):
    return lexical.search(I.passages(spark, d), I.questions(spark, d), 1000).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_pruned", f"WITH {S.BM25} SELECT qid, pid, score, rank FROM bm WHERE rank <= 10")
def bm25_pruned(spark, d):
    """Two deliveries, each a segment of an impact-ordered index; the ten best of each question from both."""
    index = ImpactIndex(spark, storage.scratch(spark, "index"), buckets=16)
    for odd in (False, True):
        index.add(I.passages(spark, d).filter((F.crc32(F.col("pid").cast("binary")) % 2 == 1) == odd))
    return index.search(I.questions(spark, d), 10).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("run_rank", f"WITH {S.BM25} SELECT qid || ' Q0 ' || pid || ' ' || CAST(rank AS VARCHAR) || ' ' || CAST(200 - rank AS VARCHAR) || ' bm25' AS line FROM bm")
def run_rank(spark, d):
    run = lexical.search(I.passages(spark, d), I.questions(spark, d), 1000)
    lines = writers.run_lines(run, "bm25", seven=True)
    return lines.select(F.regexp_replace("value", r" \S+ bm25$", " bm25").alias("line"))


_DENSE = """vq AS (SELECT CAST(vec_id AS VARCHAR) AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
vp AS (SELECT CAST(vec_id AS VARCHAR) AS pid, vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dp AS (SELECT qid, pid, vec_id, round(list_dot_product(q, v), 6) AS score FROM vq, vp)"""


@query("dense_topk", f"WITH {_DENSE} SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM dp) WHERE rank <= 1000")
def dense_topk(spark, d):
    return dense.topk(I.vectors(spark, d), I.vector_queries(spark, d), 1000).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_topk_pruned", f"WITH {_DENSE} SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM dp) WHERE rank <= 100")
def dense_topk_pruned(spark, d):
    return pruned_dense.topk(I.vectors(spark, d), I.vector_queries(spark, d), 100, block=256).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_topk_blocked", f"""WITH {_DENSE}, n AS (SELECT vec_id, ntile(4) OVER (ORDER BY vec_id) - 1 AS block FROM embeddings), hb AS (SELECT qid, pid, vec_id, block, score, row_number() OVER (PARTITION BY qid, block ORDER BY score DESC, pid) AS pos FROM dp JOIN n USING (vec_id)),
hk AS (SELECT * FROM hb WHERE pos <= 1000) SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, block, pos) AS rank FROM hk) WHERE rank <= 1000""")
def dense_topk_blocked(spark, d):
    numbered = indexing.row_index(I.vectors(spark, d), "vec_id")
    hits = dense.topk(indexing.array_split(numbered, 4), I.vector_queries(spark, d), 1000, parts=4).withColumnRenamed("rank", "pos")
    return dense.merge_blocks(hits, 1000).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_dedupe_rank", f"""WITH {_DENSE}, g AS (SELECT qid, CAST(vec_id % 100 AS VARCHAR) AS pid, score FROM dp), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM g), o AS (SELECT qid, pid, max(score) AS score FROM c WHERE r <= 1000 GROUP BY qid, pid)
SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM o""")
def dense_dedupe_rank(spark, d):
    doubled = I.vectors(spark, d).withColumn("pid", (F.col("vec_id") % 100).cast("string"))
    return dense.dedupe(dense.topk(doubled, I.vector_queries(spark, d), 1000), 1000).select("qid", "pid", "score", F.col("rank").cast("long").alias("rank"))


@query("query_mean_pool", """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), y AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS i, round(v, 6) + 0.0 AS v FROM y""")
def query_mean_pool(spark, d):
    out = dense.mean_vectors(I.vectors(spark, d), "label")
    return out.select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


@query("masked_mean", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, i FROM embeddings, range(8) x(i))
SELECT vec_id, i AS place, round((e[1 + i] + e[17 + i] + e[33 + i] + e[49 + i]) / 4, 6) + 0.0 AS first, round((e[9 + i] + e[25 + i] + e[41 + i] + e[57 + i]) / 4, 6) + 0.0 AS second FROM e""")
def masked_mean(spark, d):
    """Each vector as eight tokens of eight components; every other token counts, then the others."""
    tokens = F.array(*[F.slice("vector", 8 * i + 1, 8) for i in range(8)])
    first, second = (dense.masked_mean(tokens, F.array(*map(F.lit, mask * 4))) for mask in ((1, 0), (0, 1)))
    out = I.vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("place", "m"))
    return out.select("vec_id", F.col("place").cast("long").alias("place"), *[(F.round(f"m.{c}", 6) + 0.0).alias(name) for c, name in (("a", "first"), ("b", "second"))])


@query("encode_hash", """WITH x AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 8) AS places FROM documents)
SELECT doc_id, array_to_string(list_transform(range(8), lambda i: len(list_filter(places, lambda p: p = i))), '|') AS v FROM x""")
def encode_hash(spark, d):
    return I.table(spark, d, "documents").select("doc_id", joined(dense.hash_encode(F.col("text")).cast("array<long>")).alias("v"))


def _length_encoder():
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)


@query("embed_collection", "SELECT CAST(doc_id AS VARCHAR) AS pid, CAST(len(text) AS DOUBLE) AS first, CAST(len(text) - len(replace(text, ' ', '')) AS DOUBLE) AS second FROM documents")
def embed_collection(spark, d):
    out = dense.encode(I.passages(spark, d), "text", _length_encoder)
    return out.select("pid", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(1)).cast("double").alias("second"))


@query("embed_blocks", "SELECT CAST(doc_id AS VARCHAR) AS pid, CAST(len(text) AS DOUBLE) AS first, CAST(len(text) - len(replace(text, ' ', '')) AS DOUBLE) AS second FROM documents")
def embed_blocks(spark, d):
    """The collection by an embedding job that is run twice: the second finds every block done."""
    path = storage.scratch(spark, "embedding")
    for _ in range(2):
        embedding_job.embed(I.passages(spark, d), path, _length_encoder, "lengths", blocks=32)
    out = embedding_job.vectors(spark, path)
    return out.select("pid", *[F.get("vector", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("first", "second"))])



# --- collection preparation and checks ---


@query("shard_roundrobin", "SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) % 32 AS BIGINT) AS shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY ALL".replace("SELECT CAST(", "SELECT shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CAST(", 1).replace(" AS shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY ALL", " AS shard FROM documents) GROUP BY shard"))
def shard_roundrobin(spark, d):
    rows = indexing.round_robin(indexing.row_index(I.table(spark, d, "documents").select("doc_id"), "doc_id"), 32)
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("pid_offset_map", 'SELECT pid, row_number() OVER (ORDER BY i % 32, i) - 1 AS "offset" FROM (SELECT CAST(doc_id AS VARCHAR) AS pid, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)')
def pid_offset_map(spark, d):
    return indexing.offsets(indexing.row_index(I.table(spark, d, "documents").select("doc_id"), "doc_id")).select(F.col("doc_id").cast("string").alias("pid"), "offset")


@query("block_ntile", "SELECT vec_id, CAST(ntile(7) OVER (ORDER BY vec_id) - 1 AS BIGINT) AS block FROM embeddings")
def block_ntile(spark, d):
    return indexing.array_split(indexing.row_index(I.vectors(spark, d).select("vec_id"), "vec_id"), 7).select("vec_id", F.col("block").cast("long").alias("block"))


_IDS = "x AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: len(w)) AS ids FROM documents)"


def _lengths(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.transform(text.tokenize(F.col("text")), lambda w: F.length(w)).alias("ids"))


@query("pad_query_tokens", f"WITH {_IDS} SELECT doc_id, array_to_string(list_resize(CASE WHEN len(ids) > 24 THEN ids[len(ids) - 23:] ELSE ids END, 24, 0), '|') AS ids FROM x")
def pad_query_tokens(spark, d):
    return _lengths(spark, d).select("doc_id", joined(text.pad_query(F.col("ids"), 24)).alias("ids"))


@query("pad_passage_tokens", f"WITH {_IDS} SELECT doc_id, array_to_string(list_resize(ids[1:24], 24, 0), '|') AS ids FROM x")
def pad_passage_tokens(spark, d):
    return _lengths(spark, d).select("doc_id", joined(text.pad_passage(F.col("ids"), 24)).alias("ids"))


@query("attention_mask", f"WITH {_IDS} SELECT doc_id, repeat('1', least(len(ids), 24)) || repeat('0', 24 - least(len(ids), 24)) AS mask FROM x")
def attention_mask(spark, d):
    return _lengths(spark, d).select("doc_id", F.array_join(text.attention_mask(F.col("ids"), 24).cast("array<string>"), "").alias("mask"))


@query("verify_width", f"WITH {_IDS} SELECT count(*) AS n_records, count(*) FILTER (doc_id % 50 = 7 AND len(ids) <> 16) AS n_wrong FROM x")
def verify_width(spark, d):
    short = I.table(spark, d, "documents").select(F.col("doc_id").alias("offset"), F.transform(text.tokenize(F.col("text")), lambda w: F.length(w)).alias("ids")).filter("offset % 50 = 7")
    records = _records(spark, d, 16).join(short, "offset", "left").withColumn("token_ids", F.coalesce("ids", "token_ids"))
    wrong = indexing.wrong_widths(records, 16).agg(F.count(F.lit(1)).alias("n_wrong"))
    return records.agg(F.count(F.lit(1)).alias("n_records")).select("n_records", wrong.select("n_wrong").scalar().alias("n_wrong"))


@query("verify_mapping", """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS pid, doc_id AS "offset" FROM documents), b AS (SELECT CAST(doc_id AS VARCHAR) AS pid, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 ELSE doc_id END AS "offset" FROM documents)
SELECT 'pid_to_offset' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'offset_to_pid', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def verify_mapping(spark, d):
    docs = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pid"), F.col("doc_id").alias("offset"))
    moved = docs.withColumn("offset", F.when(F.col("offset") % 50 == 7, F.col("offset") + 1).otherwise(F.col("offset")))
    return indexing.mapping_faults(docs, moved)


@query("width_probe", f"WITH {_IDS} SELECT count(*) FILTER (len(ids) <> 16) AS n_wrong FROM (SELECT * FROM x ORDER BY doc_id LIMIT 3)")
def width_probe(spark, d):
    records = I.table(spark, d, "documents").select(F.col("doc_id").alias("offset"), F.transform(text.tokenize(F.col("text")), lambda w: F.length(w)).alias("token_ids"))
    return indexing.wrong_widths(records, 16, first=3).agg(F.count(F.lit(1)).alias("n_wrong"))


@query("pid_field", "SELECT source, CAST(64 AS BIGINT) AS n_bytes, source AS pid FROM (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS source FROM documents)")
def pid_field(spark, d):
    rows = I.table(spark, d, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("source"))
    field = indexing.pid_field(F.col("source"))
    return rows.select("source", F.octet_length(field).cast("long").alias("n_bytes"), indexing.pid_of_field(field).alias("pid"))


@query("query_records", "WITH x AS (SELECT CAST(item_id AS BIGINT) AS qid, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: len(w)) AS ids FROM benchmark) SELECT qid, CAST(least(len(ids), 24) AS BIGINT) AS n_tokens, array_to_string(list_resize(ids[1:24], 24, 0), '|') AS token_ids FROM x")
def query_records(spark, d):
    rows = I.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.transform(text.tokenize(F.col("text")), lambda w: F.length(w)).alias("ids"))
    return indexing.query_records(rows, 24).select("qid", F.col("n_tokens").cast("long").alias("n_tokens"), joined(F.col("token_ids")).alias("token_ids"))


@query("largest_block", "SELECT max(doc_id // 100) AS block FROM documents")
def largest_block(spark, d):
    names = I.table(spark, d, "documents").select(F.concat(F.lit("passage_emb_block_"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".pb")).alias("value"))
    return indexing.largest_block(names)


_PATHS = "SELECT conv_id, turn, 'data/' || CASE conv_id % 3 WHEN 0 THEN '2023/' WHEN 1 THEN '2024/' ELSE '' END || 'queries_' || CAST(conv_id AS VARCHAR) || '.jsonl' AS source FROM conversations"


@query("run_paths", f"""WITH x AS ({_PATHS}) SELECT source, 'data/results/trec_files/' || CASE conv_id % 3 WHEN 0 THEN '2023/' WHEN 1 THEN '2024/' ELSE '' END || 'bm25_queries_' || CAST(conv_id AS VARCHAR) || '_qtype_concat_ttype_full_r1.trec' AS path, '_gpt' || CAST(turn AS VARCHAR) AS part FROM x""")
def run_paths(spark, d):
    year = F.when(F.col("conv_id") % 3 == 0, F.lit("2023/")).when(F.col("conv_id") % 3 == 1, F.lit("2024/")).otherwise(F.lit(""))
    source = F.concat(F.lit("data/"), year, F.lit("queries_"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    rows = I.table(spark, d, "conversations").select("turn", source.alias("source"))
    model = F.concat(F.lit("gpt"), F.col("turn").cast("string"), F.lit("/large"))
    return rows.select("source", writers.run_path(F.col("source"), "bm25_", query_type="concat", test_type="full", tag="r1").alias("path"), writers.model_part(model, "default").alias("part"))


@query("run_lines_dense", f"WITH {_DENSE} SELECT qid || ' Q0 ' || pid || ' ' || CAST(rank AS VARCHAR) || ' dense' AS line FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM dp) WHERE rank <= 100")
def run_lines_dense(spark, d):
    run = dense.topk(I.vectors(spark, d), I.vector_queries(spark, d), 100)
    return writers.run_lines(run, "dense").select(F.regexp_replace("value", r" \S+ dense$", " dense").alias("line"))


_RUNS = "SELECT 'topic' || CAST(conv_id AS VARCHAR) AS base, CAST(turn + 1 AS BIGINT) AS run FROM conversations"


def _runs(spark, d):
    return I.table(spark, d, "conversations").select(F.concat(F.lit("topic"), F.col("conv_id").cast("string")).alias("base"), (F.col("turn") + 1).cast("long").alias("run"))


@query("next_run", f"WITH r AS ({_RUNS}), u AS (SELECT base, run FROM r UNION ALL SELECT DISTINCT base, 0 FROM r), g AS (SELECT base, run + 1 AS free FROM u WHERE (base, run + 1) NOT IN (SELECT (base, run) FROM r)) SELECT base, min(free) AS next_run FROM g GROUP BY base")
def next_run(spark, d):
    return writers.next_run(_runs(spark, d))


@query("complete_runs", f"WITH r AS ({_RUNS}) SELECT base FROM r WHERE run BETWEEN 1 AND 3 GROUP BY base HAVING count(DISTINCT run) = 3")
def complete_runs(spark, d):
    return writers.complete_runs(_runs(spark, d), 3)


@query("registry_upsert", "SELECT CAST(doc_id AS VARCHAR) AS filename, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS batch_id FROM documents")
def registry_upsert(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("filename"))
    old, new = (x.select("filename", F.lit(v).alias("batch_id")) for x, v in ((rows, "old"), (rows.filter("doc_id % 3 = 0"), "new")))
    return writers.upsert(old, new)


@query("union_collection", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR) FROM benchmark")
def union_collection(spark, d):
    return I.passages(spark, d).select(F.col("pid").alias("id")).unionAll(I.questions(spark, d).select("qid"))


_TRAIN = """ex AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query, CAST(item_id AS VARCHAR) AS positive, CAST(item_id + n AS VARCHAR) AS negative FROM benchmark, (SELECT unnest([1, 2, 3]) AS n) WHERE item_id + 3 < (SELECT min(m) FROM (SELECT count(*) AS m FROM documents)))"""


def _examples(spark, d):
    q = I.table(spark, d, "benchmark")
    n = I.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    i = F.col("item_id")
    ex = q.filter(i + 3 < n).select(i.cast("string").alias("qid"), i.cast("string").alias("positive"), F.array(*[(i + k).cast("string") for k in (1, 2, 3)]).alias("negatives"))
    return ex, I.questions(spark, d), I.passages(spark, d)


@query("training_pairs", f"WITH {_TRAIN}, p AS (SELECT qid, query, positive AS pid, 1 AS label FROM ex UNION ALL SELECT qid, query, negative, 0 FROM ex) SELECT qid, query, pid, sha256(text) AS passage_sha, CAST(label AS BIGINT) AS label FROM p JOIN documents ON CAST(doc_id AS VARCHAR) = pid")
def training_pairs(spark, d):
    return indexing.training_pairs(*_examples(spark, d)).select("qid", "query", "pid", F.sha2("passage", 256).alias("passage_sha"), F.col("label").cast("long").alias("label"))


@query("training_triplets", f"WITH {_TRAIN} SELECT qid, query, positive, negative, sha256(a.text || b.text) AS texts_sha FROM ex JOIN documents a ON CAST(a.doc_id AS VARCHAR) = positive JOIN documents b ON CAST(b.doc_id AS VARCHAR) = negative")
def training_triplets(spark, d):
    return indexing.training_triplets(*_examples(spark, d)).select("qid", "query", "positive", "negative", F.sha2(F.concat("positive_text", "negative_text"), 256).alias("texts_sha"))


# --- evaluation ---


def _judged(spark, d):
    return readers.qrels(I.judgement_lines(spark, d))


def _metrics(spark, d):
    return evaluation.per_query(readers.run(I.run_lines(spark, d)), _judged(spark, d))


def _metric_query(name: str, columns: tuple[str, ...]):
    sql = f"WITH {S.JUDGED}, {S.RUN}, {S.metrics('r')} SELECT qid, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + " FROM m"
    query(name, sql)(lambda spark, d: _metrics(spark, d).select("qid", *[F.round(c, 6).alias(c) for c in columns]))


_metric_query("eval_map", ("map",))
_metric_query("eval_mrr", ("recip_rank",))
_metric_query("eval_recall_at_k", ("recall_5", "recall_10", "recall_20", "recall_1000"))
_metric_query("eval_p_at_k", ("P_20",))
_metric_query("eval_ndcg_at_k", ("ndcg_cut_3", "ndcg_cut_5", "ndcg_cut_1000"))


@query("eval_summary", f"WITH {S.BM25}, {S.JUDGED}, {S.metrics('bm')} {S.reported()}")
def eval_summary(spark, d):
    run = lexical.search(I.passages(spark, d), I.questions(spark, d), 1000)
    return evaluation.summary(evaluation.per_query(run, _judged(spark, d)))


@query("eval_filtered", f"WITH {S.JUDGED}, {S.RUN}, {S.metrics('r')} {S.reported('(SELECT * FROM m WHERE CAST(qid AS BIGINT) % 3 = 1)')}")
def eval_filtered(spark, d):
    ids = I.questions(spark, d).filter("cast(qid as long) % 3 = 1")
    return evaluation.summary(evaluation.on_subset(_metrics(spark, d), ids))


_AUTO = f"{S.JUDGED}, {S.RUN}, ra AS (SELECT qid, pid, CAST((CAST(pid AS BIGINT) // 5) % 4 AS VARCHAR) AS ptkb, score, line_no FROM r), {S.metrics('ra', 'qid, ptkb')}, fs AS (SELECT ptkb, min(line_no) AS seen FROM ra GROUP BY ptkb)"


def _automatic(spark, d, always):
    lines = readers.run(I.run_lines(spark, d)).withColumn("qid", F.concat_ws("-", "qid", (F.floor(F.col("pid").cast("long") / 5) % 4).cast("string")))
    split = evaluation.split_automatic(lines)
    best = evaluation.best_fact(evaluation.per_query(split, _judged(spark, d), ("qid", "ptkb")), evaluation.first_seen(split), always)
    return best.select("qid", "ptkb", F.round("ndcg_cut_3", 6).alias("ndcg_cut_3"), F.round("map", 6).alias("map"))


_BEST = "SELECT qid, ptkb, round(ndcg_cut_3, 6) AS ndcg_cut_3, round(map, 6) AS map FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ndcg_cut_3 DESC, seen) AS n FROM m JOIN fs USING (ptkb) {}) WHERE n = 1"


@query("eval_automatic_baseline", f"WITH {_AUTO} {_BEST.format('')}")
def eval_automatic_baseline(spark, d):
    return _automatic(spark, d, False)


@query("eval_automatic_always", f"WITH {_AUTO} {_BEST.format(chr(87) + 'HERE ptkb <> ' + repr('0'))}")
def eval_automatic_always(spark, d):
    return _automatic(spark, d, True)


@query("eval_automatic", f"WITH {_AUTO} SELECT qid, ptkb, round(map, 6) AS map, round(recip_rank, 6) AS recip_rank, round(ndcg_cut_3, 6) AS ndcg_cut_3 FROM m")
def eval_automatic(spark, d):
    lines = readers.run(I.run_lines(spark, d)).withColumn("qid", F.concat_ws("-", "qid", (F.floor(F.col("pid").cast("long") / 5) % 4).cast("string")))
    m = evaluation.per_query(evaluation.split_automatic(lines), _judged(spark, d), ("qid", "ptkb"))
    return m.select("qid", "ptkb", *[F.round(c, 6).alias(c) for c in ("map", "recip_rank", "ndcg_cut_3")])


_STATS = "round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS variance, round(median(value), 6) AS median"


def _rounded(rows):
    return rows.select(*[F.round(c, 6).alias(c) if c in ("min", "max", "mean", "std", "variance", "median") else F.col(c) for c in rows.columns])


@query("agg_run_stats", f"WITH {S.run_values()} SELECT name, subset, metric, {_STATS} FROM vl GROUP BY name, subset, metric")
def agg_run_stats(spark, d):
    return _rounded(evaluation.run_statistics(evaluation.long_metrics(I.run_values(spark, d), "position", "name", "subset", "run"), "name", "subset", "metric"))


@query("agg_run_grid", f"WITH {S.run_values()}, g AS (SELECT *, CASE WHEN position = 0 THEN subset || CASE WHEN run % 2 = 0 THEN '_baseline' ELSE '_always_ptkb' END ELSE subset END AS variant FROM vl) SELECT name, variant, metric, {_STATS}, count(*) AS runs FROM g GROUP BY name, variant, metric")
def agg_run_grid(spark, d):
    rows = evaluation.long_metrics(I.run_values(spark, d), "position", "name", "subset", "run")
    variant = F.when(F.col("position") == 0, F.concat("subset", F.when(F.col("run") % 2 == 0, F.lit("_baseline")).otherwise(F.lit("_always_ptkb")))).otherwise(F.col("subset"))
    rows = rows.withColumn("variant", variant)
    counts = rows.groupBy("name", "variant", "metric").agg(F.count(F.lit(1)).alias("runs"))
    return _rounded(evaluation.run_statistics(rows, "name", "variant", "metric")).join(counts, ["name", "variant", "metric"])


@query("ttest_pairs", f"""WITH {S.run_values()}, st AS (SELECT position, name, subset, metric, avg(value) AS mean, stddev_pop(value) AS std FROM vl WHERE metric IN ('MRR', 'NDCG@3', 'NDCG@5', 'MAP') GROUP BY ALL),
tt AS (SELECT a.name AS name1, b.name AS name2, a.subset, a.metric, (a.mean - b.mean) / sqrt((a.std * a.std + b.std * b.std) / 2 * (2.0 / 5)) AS t FROM st a JOIN st b ON a.subset = b.subset AND a.metric = b.metric AND a.position < b.position),
pp AS (SELECT *, atan(abs(t) / sqrt(8.0)) AS th FROM tt), p AS (SELECT *, 1 - sin(th) * (1 + 1.0 / 2 * cos(th) ** 2 + 3.0 / 8 * cos(th) ** 4 + 15.0 / 48 * cos(th) ** 6) AS p FROM pp)
SELECT name1, name2, subset, metric, round(t, 6) AS t, round(p, 6) AS p FROM p WHERE p < 0.05""")
def ttest_pairs(spark, d):
    stats = evaluation.run_statistics(evaluation.long_metrics(I.run_values(spark, d), "position", "name", "subset", "run"), "position", "name", "subset", "metric")
    out = evaluation.significant(evaluation.t_tests(stats))
    return out.select("name1", "name2", "subset", "metric", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


@query("dataset_stats", f"""WITH {S.TURNS} SELECT 'topics' AS variable, count(DISTINCT title) AS value FROM t UNION ALL SELECT 'conversations', count(DISTINCT number) FROM t UNION ALL SELECT 'turns', count(*) FROM t
UNION ALL SELECT 'total_ptkb_turns', count(*) FROM t WHERE len(prov) > 0 UNION ALL SELECT 'assessed_turns', count(*) FROM ids UNION ALL SELECT 'collection', count(*) FROM documents""")
def dataset_stats(spark, d):
    return dialogue.dataset_stats(I.topics(spark, d), I.assessed(spark, d), I.passages(spark, d)).select("variable", F.col("value").cast("long").alias("value"))


@query("experiment_grid", """SELECT year, type, CAST(shot AS BIGINT) AS shot, CAST(prompt AS BIGINT) AS prompt, split, CAST(run AS BIGINT) AS run, turns FROM (SELECT unnest(['2023', '2024']) AS year), (SELECT unnest(['SAR', 'LLM', 'All', 'None', 'human', 'automatic']) AS type), (SELECT unnest([0, 1, 3, 5]) AS shot), (SELECT unnest([0, 1, 2]) AS prompt), (SELECT unnest([FALSE, TRUE]) AS split)
JOIN (SELECT conv_id % 5 + 1 AS run, count(*) AS turns FROM conversations GROUP BY 1) ON true WHERE (type IN ('SAR', 'LLM') OR shot = 0) AND ((type = 'SAR') = (prompt = 0)) AND (NOT split OR prompt = 1)""")
def experiment_grid(spark, d):
    """The grid of experiments with the turns that each run has before it: a fifth of the conversations."""
    turns = I.table(spark, d, "conversations").groupBy((F.col("conv_id") % 5 + 1).cast("int").alias("run")).agg(F.count(F.lit(1)).alias("turns"))
    return experiments.grid(spark).join(turns, "run").select("year", "type", *[F.col(c).cast("long").alias(c) for c in ("shot", "prompt", "run")], "split", "turns")
