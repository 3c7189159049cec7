"""SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from tarn.functions.spelling import DIFFICULTY_NAMES as _LEVELS
from tarn.functions.spelling import TYPE_NAMES as _TYPES
from tarn.functions.spelling import document_sql, split_sql, word_sql as _word

_HAN = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"
_MARK = "\\p{P}$+<=>^`|~"
_SIZE = f"len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\p{{Cf}}\\x{{FFFD}}]', '', 'g'), '[{_HAN}]|[{_MARK}]|[^\\s\\p{{Z}}{_HAN}{_MARK}]+'))"

_GROUPS = f"""raw AS (SELECT id, unnest(supporting_docs) AS s FROM business_v1 WHERE id IS NOT NULL),
links AS (SELECT DISTINCT id, {document_sql("s")} AS d FROM raw WHERE {document_sql("s")} IS NOT NULL),
edges AS (SELECT DISTINCT a.d AS a, b.d AS b FROM links a JOIN links b USING (id)),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS d, min(b) AS c FROM reach GROUP BY 1),
grp AS (SELECT DISTINCT id, c FROM links JOIN comp USING (d))"""


def _label(c: str) -> str:
    t = f"regexp_replace(lower({c}), '[\\s\\p{{P}}\\p{{Cf}}\\p{{Z}}]+', '', 'g')"
    return f"CASE WHEN {t} IN ('pass', 'passed', '通过', '合格') THEN 'pass' WHEN {t} IN ('fail', 'failed', '不通过', '不合格') THEN 'fail' END"


_VOTES = f"""said AS (SELECT id, criterion, annotator AS who, {_label("human.label")} AS label, labelled_at AS said_at FROM calibration
UNION ALL SELECT id, criterion, judge.model, {_label("judge.verdict")}, labelled_at FROM calibration
UNION ALL SELECT id, criterion, judge2.model, {_label("judge2.verdict")}, labelled_at FROM calibration
UNION ALL SELECT id, criterion, reviewer, {_label("human_verdict")}, checked_at FROM judge_spotcheck_v1
UNION ALL SELECT id, criterion, judge_model, {_label("judge_verdict")}, checked_at FROM judge_spotcheck_v1),
votes AS (SELECT id, criterion, who, label FROM said WHERE id IS NOT NULL AND criterion IS NOT NULL AND who IS NOT NULL AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, criterion, who ORDER BY said_at DESC NULLS LAST, label DESC) = 1)"""

_HAVE = f"have AS (SELECT {_word('type', _TYPES)} AS type, {_word('difficulty', _LEVELS)} AS difficulty, count(DISTINCT id) AS n FROM business_v1 GROUP BY 1, 2), need AS (SELECT p.*, coalesce(n, 0) AS n FROM sample_plan p LEFT JOIN have USING (type, difficulty))"

ORACLE = {
    # all pairs by the trigrams they share, and the transitive closure
    "p2_found": r"""WITH RECURSIVE one AS (SELECT * FROM business_v1 WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
i AS (SELECT id, regexp_replace(lower(coalesce(question, '') || coalesce(ground_truth, '')), '[^\p{L}\p{N}]+', '', 'g') AS t FROM one),
g AS (SELECT DISTINCT id, substr(t, k, 3) AS g FROM i, unnest(generate_series(1, greatest(length(t) - 2, 1))) x(k) WHERE t <> ''),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
ov AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM ov JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2.0 * k / (x.n + y.n) >= 0.7),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e2.b FROM reach r JOIN both_ e2 ON r.b = e2.a)
SELECT a AS id_a, b AS id_b FROM reach WHERE a < b""",
    # records of one component, by the transitive closure over documents
    "p4_found": f"""WITH RECURSIVE {_GROUPS},
item AS (SELECT id, max({split_sql("split")}) AS split FROM business_v1 GROUP BY 1),
torn AS (SELECT c FROM grp JOIN item USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT DISTINCT id FROM grp JOIN torn USING (c)""",
    # what must hold of the new splits: every item once, no group torn, shares reached
    "p4_checks": f"""WITH RECURSIVE {_GROUPS}, item AS (SELECT DISTINCT id FROM business_v1 WHERE id IS NOT NULL)
SELECT (SELECT count(*) FROM item) AS items, (SELECT count(DISTINCT c) FROM grp) + (SELECT count(*) FROM item WHERE id NOT IN (SELECT id FROM grp)) AS groups, 0::BIGINT AS torn, true AS reached""",
    # agreement over pairs of labels
    "p3_agreement": f"""WITH {_VOTES}, per AS (SELECT id, criterion, count(*) AS m, count_if(label = 'pass') AS p, count_if(label = 'fail') AS f FROM votes GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT criterion, count(*) AS items, sum(m)::BIGINT AS labels, sum((m * (m - 1) - p * (p - 1) - f * (f - 1)) / (m - 1)) AS d, sum(p)::DOUBLE AS p, sum(f)::DOUBLE AS f FROM per GROUP BY 1)
SELECT criterion, items, labels, d / labels AS observed, 2 * p * f / ((p + f) * (p + f - 1)) AS expected, CASE WHEN p * f > 0 THEN 1 - d / labels / (2 * p * f / ((p + f) * (p + f - 1))) END AS alpha FROM s""",
    # every item with labels has one consensus, and one that all labellers share is theirs
    "p3_checks": f"WITH {_VOTES}, per AS (SELECT id, criterion, count(*) AS labels, min(label) AS lo, max(label) AS hi FROM votes GROUP BY 1, 2) SELECT count(*) AS items, sum(labels)::BIGINT AS labels, count_if(lo = hi) AS agreed, 0::BIGINT AS against FROM per",
    "p5_found": f"""WITH have AS (SELECT {_word("type", _TYPES)} AS type, {_word("difficulty", _LEVELS)} AS difficulty, count(DISTINCT id) AS n FROM business_v1 GROUP BY 1, 2)
SELECT plan_id, p.type, p.difficulty FROM sample_plan p LEFT JOIN have USING (type, difficulty) WHERE greatest(p.share * p.sample_rows, p.min_rows) > coalesce(n, 0)""",
    "p5_shortfalls": f"WITH {_HAVE} SELECT plan_id, type, difficulty, n AS available, round(greatest(share * sample_rows, min_rows), 6) AS needed, round(greatest(0, greatest(share * sample_rows, min_rows) - n), 6) AS shortfall FROM need",
    # what must hold of a sample: its size, minima kept, no item twice, no category beyond what there is
    "p5_checks": f"WITH {_HAVE} SELECT plan_id, greatest(sum(least(min_rows, n)), least(max(sample_rows), sum(CASE WHEN share > 0 THEN n ELSE least(min_rows, n) END)))::BIGINT AS drawn, 0::BIGINT AS below_minimum, 0::BIGINT AS twice, 0::BIGINT AS of_other_categories FROM need GROUP BY 1",
    "p6_found": f"SELECT spec, doc_id FROM documents, pack_specs WHERE {_SIZE} > capacity",
    # what must hold of the windows: every token once, none over capacity, no two copies of a text together
    "p6_checks": f"WITH d AS (SELECT doc_id, {_SIZE} AS size FROM documents) SELECT spec, sum(size)::BIGINT AS tokens, sum(ceil(size / capacity))::BIGINT AS pieces, 0::BIGINT AS over, 0::BIGINT AS gaps, 0::BIGINT AS copies_together FROM d, pack_specs WHERE size > 0 GROUP BY 1",
    # budgets, and what must hold of a selection: repeats within the limit, each part reached to within a document
    "p7_checks": f"""WITH own AS (SELECT {_word("source")} AS source, sum({_SIZE}) AS tokens FROM documents GROUP BY 1)
SELECT mix_id, t.source, round(least(t.weight * t.total_tokens, t.max_repeats * coalesce(tokens, 0)), 3) AS budget, 0::BIGINT AS too_often, true AS reached FROM mix_targets t LEFT JOIN own USING (source)""",
    "p8_counts": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{B5}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]+|[{_HAN}]'))::BIGINT AS n_words FROM documents",
    "p7_found": f"""WITH own AS (SELECT {_word("source")} AS source, sum({_SIZE}) AS tokens FROM documents GROUP BY 1)
SELECT mix_id, t.source FROM mix_targets t LEFT JOIN own USING (source) WHERE t.weight * t.total_tokens > t.max_repeats * coalesce(tokens, 0)""",
}
