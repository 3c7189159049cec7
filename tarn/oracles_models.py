"""SQL for the queries of ``tarn.catalog_models``; what a fake model answers is stated in SQL again."""

from __future__ import annotations

from tarn.operators.evaluation import SUGGESTIONS
from tarn.oracles import BM25, CORPUS, ITEMS, LABELS, MARK, PAIRS, QUESTIONS, RES, RUNS, SENT, _num

_CHARS = "list_distinct(list_filter(string_split({}, ''), lambda x: x <> ''))"
_Q, _D = _CHARS.format("q.text"), _CHARS.format("c.text")
_CLAIMS = "coalesce(key_claims, []::VARCHAR[])"
_SUGGEST = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in SUGGESTIONS.items())
_LONG = "length(coalesce(question, ''))"
_BUSY = "(isodow(started_at) <= 5 AND (hour(started_at) BETWEEN 9 AND 11 OR hour(started_at) BETWEEN 14 AND 17))"
# of input, cached input and output, per million, as the rates of the queries state them
_IN, _HIT, _OUT = (f"CASE WHEN coalesce(type, 'none') = 'factual' THEN CASE WHEN {_BUSY} THEN {a} ELSE {b} END ELSE CASE WHEN {_BUSY} THEN {c} ELSE {d} END END" for a, b, c, d in ((4, 2, 2, 1), (4, 1, 1, 1), (6, 3, 4, 2)))
_COST = f"round(({_LONG} * 9 * {_IN} + {_LONG} * {_HIT} + ({_LONG} % 11) * {_OUT}) / 1000000.0::DOUBLE, 6)"

MORE: dict[str, str] = {
    "rt_rerank_model": f"""WITH {QUESTIONS}, {CORPUS}, {BM25},
p AS (SELECT bm.qid, bm.row_id, bm.rank AS pool_rank, len(list_intersect({_Q}, {_D}))::DOUBLE / greatest(len({_Q}), 1) AS s FROM bm JOIN questions q USING (qid) JOIN corpus c USING (row_id))
SELECT qid, row_id AS doc_id, pool_rank, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pool_rank) AS rank FROM p QUALIFY rank <= 3""",
    "md_judge": f"WITH {PAIRS} SELECT case_id, CASE WHEN contains(coalesce(answer, ''), '。') THEN 'pass' WHEN contains(coalesce(answer, ''), '[') THEN 'fail' ELSE 'pass' END AS verdict FROM pairs",  # asked again, the prompt holds the mark that passes
    "md_annotate": f"WITH {PAIRS}, p AS (SELECT case_id, coalesce(answer, '') AS t FROM pairs) SELECT case_id, CASE WHEN length(t) > 20 THEN CASE WHEN contains(t, '。') THEN 'pass' ELSE 'fail' END END AS a, CASE WHEN length(t) > 20 THEN CASE WHEN contains(t, '[') THEN 'pass' ELSE 'fail' END END AS b, length(t) <= 20 AS failed FROM p",
    "md_drafts": f"WITH {ITEMS}, p AS (SELECT id, type, length(coalesce(ground_truth, '')) + CASE type WHEN 'factual' THEN 1 ELSE 2 END AS n FROM items WHERE type IN ('factual', 'multi_hop')) SELECT id, type, '问' || n AS question, 1::BIGINT AS claims FROM p WHERE n % 3 <> 0",
    "md_verify": f"WITH {ITEMS}, p AS (SELECT id, coalesce(type, '') = 'out_of_scope' AS o, length(coalesce(question, '')) + length(coalesce(ground_truth, '')) + length(array_to_string({_CLAIMS}, '；')) + 1 AS n FROM items) SELECT id, o OR (n % 7 <> 0 AND n % 2 = 0) AS verified, CASE WHEN o THEN 'out of scope' WHEN n % 7 = 0 THEN 'no answer that can be read' ELSE '' END AS reason FROM p",
    "md_rewrite": f"WITH {ITEMS} SELECT id, md5(CASE WHEN contains(question, '吗') THEN question ELSE '改写：' || question END) AS md5 FROM items",
    "md_plan": f"WITH {ITEMS}, p AS (SELECT id, question, CASE WHEN contains(question, '吗') THEN [] ELSE list_filter(list_transform(string_split(question, '，'), lambda x: trim(x)), lambda x: x <> '') END AS l FROM items), l AS (SELECT id, CASE WHEN len(l) = 0 THEN [question] ELSE l[1:4] END AS l FROM p) SELECT id AS question_id, generate_subscripts(l, 1) - 1 AS ord, md5(unnest(l)) AS query FROM l",
    "rt_merge_blocks": "WITH b AS (SELECT label AS question_id, vec_id % 97 AS parent_id, max(round(embedding[1]::DOUBLE, 6)) AS rerank_score FROM embeddings GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, parent_id) AS rank FROM b",
    "tx_doc_of": "SELECT DISTINCT doc_id, split_part(doc_id || ':c00001', ':', 1) AS doc FROM manifest",
    "tx_context": f"WITH {ITEMS} SELECT id AS qid, md5(array_to_string(list_transform(generate_series(1, len(key_claims)), lambda i: '【参考资料' || i || '】' || chr(10) || key_claims[i]), chr(10) || chr(10))) AS md5 FROM items WHERE len(key_claims) > 0",
    "tx_numbered": f"WITH {ITEMS} SELECT id, md5(array_to_string(list_transform(generate_series(1, len(key_claims)), lambda i: '[' || i || ']' || CASE WHEN coalesce(supporting_docs[i], '') <> '' THEN '（' || supporting_docs[i] || '）' ELSE '' END || chr(10) || key_claims[i]), chr(10) || chr(10))) AS md5 FROM items WHERE len(key_claims) > 0",
    "tx_fill": f"WITH {ITEMS} SELECT id, md5('问：' || coalesce(question, '') || chr(10) || '答：' || coalesce(ground_truth, '') || chr(10) || '{{Keep}} {{}}') AS md5 FROM items",
    "tx_verdict_json": "SELECT CASE WHEN lower(trim(judge.verdict)) IN ('pass', 'fail') AND coalesce(trim(judge.evidence), '') <> '' THEN lower(trim(judge.verdict)) END AS verdict, count(*) AS n FROM calibration GROUP BY 1",
    "tx_verdicts_json": "WITH v AS (SELECT lower(trim(judge.verdict)) AS a, lower(trim(judge2.verdict)) AS b FROM calibration), k AS (SELECT a, b, coalesce(a IN ('pass', 'fail') AND b IN ('pass', 'fail'), false) AS ok FROM v) SELECT CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b, count(*) AS n FROM k GROUP BY 1, 2",
    "tx_cache_key": """SELECT DISTINCT id, criterion, sha256('{"criterion":"' || criterion || '","id":"' || id || '"}') AS key FROM calibration""",
    "tx_usage": f"WITH {RES} SELECT run_id, sum({_LONG})::BIGINT AS prompt_tokens, sum({_LONG} % 7)::BIGINT AS cache_hit_tokens, NULL::BIGINT AS completion_tokens FROM res GROUP BY 1",
    "ev_costs": f"WITH {RES} SELECT trace_id, {_COST} AS cost FROM res",
    "ev_stage_costs": f"WITH {RES}, c AS (SELECT trace_id, CASE WHEN type = 'factual' THEN {_COST} ELSE 0.0 END AS hyde, round(({_LONG} * 10 + {_LONG} % 11) * 3 / 1000000.0::DOUBLE, 6) AS rerank, {_COST} AS generation FROM res) SELECT *, round(hyde + rerank + generation, 6) AS total FROM c",
    "tx_tool_queries": f"WITH {ITEMS} SELECT id, md5(array_to_string(list_filter(list_transform({_CLAIMS}, lambda x: trim(x)), lambda x: x <> '')[1:4], '|')) AS md5 FROM items",
    "tx_citation_sources": f"WITH {PAIRS}, s AS (SELECT case_id, question, unnest({SENT}) AS sent, generate_subscripts({SENT}, 1) AS o FROM pairs WHERE answer IS NOT NULL), m AS (SELECT DISTINCT case_id, question, o, {_num('unnest(regexp_extract_all(sent, ' + chr(39) + MARK + chr(39) + '))')} AS k FROM s) SELECT case_id, o AS sent_ord, k::BIGINT AS marker, CASE WHEN k BETWEEN 1 AND 4 THEN 'd' || k END AS source_doc, CASE WHEN k BETWEEN 1 AND 4 THEN 'p' || k END AS parent_id, CASE WHEN k BETWEEN 1 AND 4 THEN md5(replace(substr(question, 1, 200), chr(10), ' ')) END AS snippet FROM m",
    "ev_suggestions": f"WITH {PAIRS} SELECT DISTINCT attribution, CASE attribution {_SUGGEST} ELSE '' END AS suggestion FROM pairs",
    "ev_slice": f"WITH {RES}, {RUNS}, x AS (SELECT id, judge['answer_correctness'].verdict AS v, coalesce(metrics.false_refusal, false) AS f FROM a WHERE type = 'multi_hop'), y AS (SELECT id, judge['answer_correctness'].verdict AS v, coalesce(metrics.false_refusal, false) AS f FROM b WHERE type = 'multi_hop'), j AS (SELECT x.v AS va, y.v AS vb, x.f AS fa, y.f AS fb, coalesce(x.v IN ('pass', 'fail') AND y.v IN ('pass', 'fail'), false) AS ok FROM x JOIN y USING (id)) SELECT count(*) AS n, count_if(ok AND va = 'pass') AS correct_before, count_if(ok AND vb = 'pass') AS correct_after, count_if(fa) AS refused_before, count_if(fb) AS refused_after FROM j",
    "ev_segment": f"WITH {LABELS} SELECT criterion, count(*) AS n FROM labels WHERE segment = 'tuning' GROUP BY 1",
    "qc_registry": f"WITH {RES} SELECT run_id, count(*) AS n, min(split) AS split, max(latency_ms) AS p95_ms, NULL::DOUBLE AS recall5 FROM res GROUP BY 1",
    "qc_united": f"WITH {ITEMS} SELECT id, CASE WHEN type = 'adversarial' THEN 'later' ELSE 'first' END AS \"of\" FROM items WHERE split = 'dev' OR type = 'adversarial'",
    "qc_filled_quotas": f"WITH {ITEMS}, q AS (SELECT * FROM (VALUES ('factual', 30, 22), ('multi_hop', 15, 11), ('colloquial', 10, 8), ('out_of_scope', 10, 8), ('adversarial', 15, 11)) t(type, total, dev)), r AS (SELECT id, type, total, dev, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM items JOIN q USING (type)) SELECT id, type, CASE WHEN k <= dev THEN 'dev' ELSE 'holdout' END AS split FROM r WHERE k <= total",
    "st_answers": f"WITH {ITEMS} SELECT id AS session, md5(array_to_string(key_claims, '')) AS answer, (2 * ((len(key_claims) - 1) // 2) + 1)::BIGINT AS usage FROM items WHERE len(key_claims) > 0",
    "sc_jsonl": f"WITH {ITEMS} SELECT id, type, md5(question) AS question, len({_CLAIMS})::BIGINT AS claims FROM items",
    "sc_form": f"WITH {LABELS} SELECT criterion, coalesce(label, 'fail') AS label, count(*) AS n FROM labels GROUP BY 1, 2",
}
