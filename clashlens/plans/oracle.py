"""Equivalent DuckDB SQL for every registered query (the correctness gate).

The SQL shares the Spark side's constants (patterns, weights, thresholds) but not its plan: it uses
the obvious relational formulation (unnest + GROUP BY + joins), so agreement checks the Spark plan.
Tables ``documents``, ``conversations``, ``embeddings``, ``labels`` ... are DuckDB views.
"""

from __future__ import annotations

import re

from clashlens.config import (CONTRADICTION_THRESHOLD, EXPECTED_SCORE_WEIGHTS, FILTERED_REASON, LABEL_ORDER,
                              MAX_SEQ_LEN, MISSING_PAIR_REASON, MISSING_TEXT_REASON, NEGATION_WORDS,
                              SCORER_WEIGHTS, SIMILARITY_THRESHOLD, SWEEP_THRESHOLDS,
                              SAMPLE_SEED, SNLI_LIMIT, MNLI_LIMIT, NLI_HEAD_LIMIT, NUM_PARAPHRASES,
                              PARAPHRASE_PROMPT, PARAPHRASE_SENTENCE_LIMIT, BATCH_SIZE)
from clashlens.functions import text as tx


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


SPLIT_MARK_SQL = f"chr({ord(tx.SPLIT_MARK)})"
GUARD_MARK_SQL = f"chr({ord(tx.GUARD_MARK)})"
NEG_LIST_SQL = "[" + ", ".join(q(w) for w in NEGATION_WORDS) + "]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(tx.STRIP_RE)}, '', 'g')"


def split_sql(x: str) -> str:
    """Sentence list of a text column, mirroring ``functions.text.split_sentences``."""
    guarded = f"regexp_replace({strip_sql(x)}, {q(tx.ABBREV_RE)}, '\\1\\2.' || {GUARD_MARK_SQL}, 'g')"
    marked = f"regexp_replace({guarded}, {q(tx.BOUNDARY_RE)}, '\\1' || {SPLIT_MARK_SQL}, 'g')"
    pieces = f"[replace(p, {GUARD_MARK_SQL}, '') for p in string_split({marked}, {SPLIT_MARK_SQL})]"
    return f"coalesce([s for s in {pieces} if s <> ''], [])"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(tx.TOKEN_RE)})"


def r(x: str, d: int) -> str:
    """Rounding as Python's ``round``: printed decimals are rounded by the exact binary value."""
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 - printf('%.{d}f', abs({x}))::DOUBLE ELSE printf('%.{d}f', {x})::DOUBLE END)"


def logit_sql(w, cos: str, jac: str, neg: str) -> str:
    b0, wc, wj, wn = w
    return f"((({b0!r} + {wc!r} * {cos}) + {wj!r} * {jac}) + {wn!r} * (CASE WHEN {neg} THEN 1.0 ELSE 0.0 END))"


def softmax_sql(cos: str, jac: str, neg: str, weights: dict | None = None) -> str:
    """Select-list fragment: entailment, neutral, contradiction (unrounded)."""
    w = weights or SCORER_WEIGHTS
    z = [logit_sql(w[k], cos, jac, neg) for k in LABEL_ORDER]
    m = f"greatest({z[0]}, {z[1]}, {z[2]})"
    e = [f"exp({zi} - {m})" for zi in z]
    s = f"(({e[0]} + {e[1]}) + {e[2]})"
    return ", ".join(f"{ei} / {s} AS {k}" for ei, k in zip(e, LABEL_ORDER))


def argmax_sql(e="entailment", n="neutral", c="contradiction") -> str:
    return (f"CASE WHEN {e} = greatest({e}, {n}, {c}) THEN 'entailment' "
            f"WHEN {n} = greatest({e}, {n}, {c}) THEN 'neutral' ELSE 'contradiction' END")


def cos_sql(dot: str, na: str, nb: str) -> str:
    return f"CASE WHEN ({na} * {nb}) > 0 THEN ({dot})::DOUBLE / sqrt(({na} * {nb})::DOUBLE) ELSE 0.0 END"


def jac_sql(shared: str, da: str, db: str) -> str:
    return f"CASE WHEN ({da} + {db} - {shared}) > 0 THEN ({shared})::DOUBLE / ({da} + {db} - {shared})::DOUBLE ELSE 0.0 END"


ES = (f"entailment * {EXPECTED_SCORE_WEIGHTS[0]!r} + neutral * {EXPECTED_SCORE_WEIGHTS[1]!r} "
      f"+ contradiction * {EXPECTED_SCORE_WEIGHTS[2]!r}")
PEARSON = "CASE WHEN ({x}) * ({y}) > 0 THEN ({c}) / sqrt(({x}) * ({y})) END"
F1 = "CASE WHEN 2 * ({tp}) + ({fp}) + ({fn}) > 0 THEN (2 * ({tp}))::DOUBLE / (2 * ({tp}) + ({fp}) + ({fn}))::DOUBLE ELSE 0.0 END"


def doc_ctes(threshold: float = SIMILARITY_THRESHOLD, ct: float = CONTRADICTION_THRESHOLD) -> str:
    """CTEs arr, sents, tf, vec, cand, scored over ``documents``."""
    return f"""
arr AS (SELECT doc_id, {split_sql('text')} AS sents FROM documents),
sents AS (SELECT doc_id, unnest(generate_series(0, len(sents) - 1)) AS idx, unnest(sents) AS sentence FROM arr),
tok AS (SELECT doc_id, idx, unnest({tokens_sql('sentence')}) AS token FROM sents),
tf AS (SELECT doc_id, idx, token, count(*) AS tf FROM tok GROUP BY doc_id, idx, token),
vec AS (SELECT doc_id, idx, sum(tf * tf) AS nsq, count(*) AS nd,
               bool_or(list_contains({NEG_LIST_SQL}, token)) AS neg FROM tf GROUP BY doc_id, idx),
pairs AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, sum(a.tf * b.tf) AS dot, count(*) AS shared
          FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.token = b.token AND a.idx < b.idx
          GROUP BY a.doc_id, a.idx, b.idx),
feat AS (SELECT p.doc_id, p.i, p.j, p.dot, {cos_sql('p.dot', 'va.nsq', 'vb.nsq')} AS cos,
                {jac_sql('p.shared', 'va.nd', 'vb.nd')} AS jac, (va.neg <> vb.neg) AS neg
         FROM pairs p JOIN vec va ON va.doc_id = p.doc_id AND va.idx = p.i
                      JOIN vec vb ON vb.doc_id = p.doc_id AND vb.idx = p.j),
cand AS (SELECT * FROM feat WHERE cos >= {threshold!r}),
scored AS (SELECT *, {softmax_sql('cos', 'jac', 'neg')} FROM cand),
cnt AS (SELECT doc_id, count(*) AS filtered_pairs,
               count(*) FILTER (WHERE contradiction >= {ct!r}) AS contradiction_count
        FROM scored GROUP BY doc_id),
stats AS (SELECT a.doc_id, len(a.sents) AS total_sentences,
                 (len(a.sents)::BIGINT * (len(a.sents)::BIGINT - 1)) // 2 AS total_pairs,
                 coalesce(c.filtered_pairs, 0) AS filtered_pairs,
                 coalesce(c.contradiction_count, 0) AS contradiction_count
          FROM arr a LEFT JOIN cnt c ON a.doc_id = c.doc_id),
stats2 AS (SELECT *, {r('(1.0 - filtered_pairs::DOUBLE / greatest(total_pairs, 1)::DOUBLE) * 100.0', 2)} AS filter_reduction_pct,
                  {r('1.0 - contradiction_count::DOUBLE / greatest(filtered_pairs, 1)::DOUBLE', 4)} AS consistency_score
           FROM stats),
cp AS (SELECT doc_id, unnest(generate_series(0, len(sents) - 2)) AS idx, sents FROM arr),
cpairs AS (SELECT doc_id, idx, sents[idx + 1] AS sentence1, sents[idx + 2] AS sentence2 FROM cp),
adot AS (SELECT a.doc_id, a.idx, sum(a.tf * b.tf) AS dot, count(*) AS shared
         FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1 AND a.token = b.token
         GROUP BY a.doc_id, a.idx),
afeat AS (SELECT p.doc_id, p.idx, p.sentence1, p.sentence2,
                 {cos_sql('coalesce(d.dot, 0)', 'coalesce(va.nsq, 0)', 'coalesce(vb.nsq, 0)')} AS cos,
                 {jac_sql('coalesce(d.shared, 0)', 'coalesce(va.nd, 0)', 'coalesce(vb.nd, 0)')} AS jac,
                 (coalesce(va.neg, false) <> coalesce(vb.neg, false)) AS neg
          FROM cpairs p LEFT JOIN vec va ON va.doc_id = p.doc_id AND va.idx = p.idx
                        LEFT JOIN vec vb ON vb.doc_id = p.doc_id AND vb.idx = p.idx + 1
                        LEFT JOIN adot d ON d.doc_id = p.doc_id AND d.idx = p.idx),
ascored AS (SELECT *, {softmax_sql('cos', 'jac', 'neg')} FROM afeat),
graded AS (SELECT CASE WHEN a.doc_id % 10 < 7 THEN 'train' WHEN a.doc_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split,
                  a.*, (2.5 * (1 + l.quality - l.toxic))::DOUBLE AS score
           FROM ascored a JOIN labels l ON l.doc_id = a.doc_id),
graded2 AS (SELECT *, score AS score05,
                   CASE WHEN score >= 3.5 THEN 'consistent' WHEN score <= 2.0 THEN 'contradiction' ELSE 'neutral' END AS label
            FROM graded),
wide AS (SELECT *, CASE WHEN label = 'contradiction' THEN 1 ELSE 0 END AS gold_bin,
                5.0 * cos AS pred_embedding, (5.0 * cos < 2.0)::INTEGER AS bin_embedding,
                {ES} AS pred_verifier, (contradiction >= {ct!r})::INTEGER AS bin_verifier,
                CASE WHEN cos >= {threshold!r} THEN {ES} ELSE 5.0 * cos END AS pred_two_stage,
                CASE WHEN cos >= {threshold!r} THEN (contradiction >= {ct!r})::INTEGER ELSE (5.0 * cos <= 2.0)::INTEGER END AS bin_two_stage,
                CASE WHEN cos >= {threshold!r} THEN entailment ELSE 0.0 END AS entail_conf,
                CASE WHEN cos >= {threshold!r} THEN contradiction WHEN 5.0 * cos <= 2.0 THEN 1.0 ELSE 0.0 END AS contra_conf
         FROM graded2),
long AS (SELECT split, doc_id, idx, score05 AS gold, gold_bin, 'embedding' AS method, pred_embedding AS pred, bin_embedding AS pred_bin FROM wide
         UNION ALL SELECT split, doc_id, idx, score05, gold_bin, 'verifier', pred_verifier, bin_verifier FROM wide
         UNION ALL SELECT split, doc_id, idx, score05, gold_bin, 'two_stage', pred_two_stage, bin_two_stage FROM wide),
ranked AS (SELECT *, rank() OVER (PARTITION BY split, method ORDER BY pred) + (count(*) OVER (PARTITION BY split, method, pred) - 1) / 2.0 AS rp,
                     rank() OVER (PARTITION BY split, method ORDER BY gold) + (count(*) OVER (PARTITION BY split, method, gold) - 1) / 2.0 AS rg
           FROM long),
cmp AS (SELECT split, method, count(*) AS n_pairs,
               {r(PEARSON.format(c='covar_pop(pred, gold)', x='var_pop(pred)', y='var_pop(gold)'), 6)} AS pearson,
               {r(PEARSON.format(c='covar_pop(rp, rg)', x='var_pop(rp)', y='var_pop(rg)'), 6)} AS spearman,
               {r(F1.format(tp='count(*) FILTER (WHERE pred_bin = 1 AND gold_bin = 1)', fp='count(*) FILTER (WHERE pred_bin = 1 AND gold_bin = 0)', fn='count(*) FILTER (WHERE pred_bin = 0 AND gold_bin = 1)'), 6)} AS f1
        FROM ranked GROUP BY split, method),
turns AS (SELECT a.conv_id, a.turn, {strip_sql("coalesce(a.text, '')")} AS sentence1, {strip_sql("coalesce(b.text, '')")} AS sentence2
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
nli_raw AS (SELECT 'documents' AS source, 0 AS source_ord, doc_id::VARCHAR || ':' || idx::VARCHAR AS key,
                   sentence1 AS premise, sentence2 AS hypothesis FROM cpairs
            UNION ALL
            SELECT 'conversations', 1, conv_id::VARCHAR || ':' || turn::VARCHAR, sentence1, sentence2 FROM turns
            WHERE sentence1 <> '' AND sentence2 <> ''),
nli_lab AS (SELECT *, (((position(substr(md5(source || ':' || key), 1, 1) IN '0123456789abcdef') - 1) % 4) - 1)::INTEGER AS label
            FROM nli_raw),
nli_s AS (SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY md5('{SAMPLE_SEED}:' || source || ':' || key), key) AS sample_ord
          FROM nli_lab WHERE label IN (0, 1, 2)),
nli AS (SELECT * FROM nli_s WHERE sample_ord <= CASE WHEN source_ord = 0 THEN {SNLI_LIMIT} ELSE {MNLI_LIMIT} END),
nhead AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY source_ord, sample_ord) AS row_ord FROM nli)
          WHERE row_ord <= {NLI_HEAD_LIMIT}),
dfirst AS (SELECT row_number() OVER (ORDER BY source_ord, sample_ord) AS first_ord, premise
           FROM (SELECT *, row_number() OVER (PARTITION BY premise ORDER BY source_ord, sample_ord) AS k FROM nli_s) WHERE k = 1),
tfirst AS (SELECT row_number() OVER (ORDER BY source_ord, sample_ord) AS first_ord, premise
           FROM (SELECT *, row_number() OVER (PARTITION BY premise ORDER BY source_ord, sample_ord) AS k FROM nli) WHERE k = 1),
psent AS (SELECT DISTINCT premise AS sentence FROM nli_s),
para AS (SELECT sentence, rank, paraphrase FROM (
           SELECT sentence, row_number() OVER (PARTITION BY sentence ORDER BY -length(text), k) AS rank, text AS paraphrase
           FROM (SELECT sentence, k, nw, array_to_string(list_concat(list_slice(w, 1, k - 1), list_slice(w, k + 1, nw + 1)), ' ') AS text
                 FROM (SELECT sentence, w, len(w) AS nw FROM (SELECT sentence,
                          regexp_split_to_array({strip_sql(f"substr({q(PARAPHRASE_PROMPT)} || sentence, {len(PARAPHRASE_PROMPT) + 1})")}, {q(tx.WS + '+')}) AS w
                       FROM psent)), range(1, {NUM_PARAPHRASES + 3}) AS t(k))
           WHERE k <= nw AND text <> '') WHERE rank <= {NUM_PARAPHRASES}),
tset AS (SELECT 0 AS part, row_ord AS ord, premise AS s1, hypothesis AS s2, label::INTEGER AS label FROM nhead
         UNION ALL
         SELECT 1, (f.first_ord - 1) * {NUM_PARAPHRASES} + p.rank, f.premise, p.paraphrase, 0
         FROM tfirst f JOIN para p ON p.sentence = f.premise WHERE f.first_ord <= {PARAPHRASE_SENTENCE_LIMIT})"""


def split_ctes(sql: str) -> dict[str, str]:
    """Name and body of each common table expression, in order."""
    out, depth, quoted, start, name = {}, 0, False, 0, ""
    for i, c in enumerate(sql):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            if depth == 0:
                name, start = sql[start:i].strip(" ,\n").removesuffix(" AS"), i
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
            if depth == 0:
                out[name], start = sql[start:i + 1], i + 1
    return out


def with_docs(body: str, **kw) -> str:
    """``body`` after the expressions that it needs; those that are read more than once are materialized."""
    ctes, uses, todo = split_ctes(doc_ctes(**kw)), {}, [body]
    while todo:
        words = re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", todo.pop()))
        for name in ctes:
            n = sum(w == name and words[i - 1].upper() in ("FROM", "JOIN", "IN") for i, w in enumerate(words) if i)
            if n and name not in uses:
                todo.append(ctes[name])
            uses[name] = uses.get(name, 0) + n if n or name in uses else 0
            if not uses[name]:
                del uses[name]
    parts = [f"{k} AS {'MATERIALIZED ' if uses[k] > 1 else ''}{v}" for k, v in ctes.items() if k in uses]
    return "WITH " + ",\n".join(parts) + "\n" + body


DOC_QUERIES = {
    "sentences": "SELECT doc_id, idx::INTEGER AS idx, sentence FROM sents",
    "encode_tf": "SELECT doc_id, idx::INTEGER AS idx, token, tf FROM tf",
    "candidate_pairs": "SELECT doc_id, i::INTEGER AS i, j::INTEGER AS j, dot::BIGINT AS dot, cos FROM cand",
    "candidate_texts": """SELECT c.doc_id, c.i::INTEGER AS i, c.j::INTEGER AS j,
        a.sents[c.i + 1] AS sentence1, a.sents[c.j + 1] AS sentence2
        FROM cand c JOIN arr a ON a.doc_id = c.doc_id""",
    "nli_scores": f"""SELECT doc_id, i::INTEGER AS i, j::INTEGER AS j, {r('entailment', 4)} AS entailment,
        {r('neutral', 4)} AS neutral, {r('contradiction', 4)} AS contradiction, {argmax_sql()} AS label FROM scored""",
    "contradictions": f"""SELECT s.doc_id, s.i::INTEGER AS i, s.j::INTEGER AS j, a.sents[s.i + 1] AS sentence1,
        a.sents[s.j + 1] AS sentence2, {r('s.contradiction', 4)} AS confidence
        FROM scored s JOIN arr a ON a.doc_id = s.doc_id WHERE s.contradiction >= {CONTRADICTION_THRESHOLD!r}""",
    "doc_pair_stats": """SELECT doc_id, total_sentences::INTEGER AS total_sentences, total_pairs, filtered_pairs,
        filter_reduction_pct FROM stats2""",
    "doc_consistency": """SELECT doc_id, filtered_pairs AS checked_pairs, contradiction_count, consistency_score
        FROM stats2""",
    "doc_report": """SELECT doc_id, total_sentences::INTEGER AS total_sentences, total_pairs, filtered_pairs,
        filter_reduction_pct, consistency_score, contradiction_count AS n_contradictions FROM stats2""",
    "doc_verdict": """SELECT doc_id, contradiction_count AS n_contradictions,
        CASE WHEN contradiction_count = 0 THEN 'Fully Consistent'
             ELSE contradiction_count::VARCHAR || ' Contradiction' || CASE WHEN contradiction_count > 1 THEN 's' ELSE '' END
        END AS verdict FROM stats2""",
    "method_cost": f"""SELECT m.method, t.documents, m.sentences_encoded, m.similarities, m.verifier_pairs,
        {r('(1.0 - m.verifier_pairs::DOUBLE / greatest(t.t, 1)::DOUBLE) * 100.0', 2)} AS verifier_reduction_pct
        FROM (SELECT count(*) AS documents, sum(total_sentences)::BIGINT AS n, sum(total_pairs)::BIGINT AS t,
                     sum(filtered_pairs)::BIGINT AS f FROM stats2) t,
        LATERAL (VALUES ('embedding_only', t.n, t.t, 0::BIGINT), ('verifier_only', 0::BIGINT, 0::BIGINT, t.t),
                        ('two_stage', t.n, t.t, t.f)) m(method, sentences_encoded, similarities, verifier_pairs)""",
}


def _verdict(c="contradiction"):
    return f"CASE WHEN {c} >= {CONTRADICTION_THRESHOLD!r} THEN 'CONTRADICTION' ELSE 'CONSISTENT' END"


def _confidence(e="entailment", n="neutral", c="contradiction"):
    return f"CASE WHEN {c} >= {CONTRADICTION_THRESHOLD!r} THEN {c} ELSE greatest({e}, {n}) END"


_T = SIMILARITY_THRESHOLD
DOC_QUERIES.update({
    "aligned_cosine": "SELECT doc_id, idx::INTEGER AS idx, cos FROM afeat",
    "pair_report": f"""SELECT doc_id, idx::INTEGER AS idx, {r('cos', 4)} AS similarity, {_T!r}::DOUBLE AS threshold,
        cos >= {_T!r} AS passed_filter,
        CASE WHEN cos >= {_T!r} THEN {r('entailment', 4)} END AS entailment,
        CASE WHEN cos >= {_T!r} THEN {r('neutral', 4)} END AS neutral,
        CASE WHEN cos >= {_T!r} THEN {r('contradiction', 4)} END AS contradiction,
        CASE WHEN cos >= {_T!r} THEN {_verdict()} ELSE 'CONSISTENT' END AS verdict,
        CASE WHEN cos >= {_T!r} THEN {r(_confidence(), 4)} END AS confidence,
        CASE WHEN NOT (cos >= {_T!r}) THEN {q(FILTERED_REASON)} END AS filtered_reason
        FROM ascored""",
    "pair_argmax": f"""SELECT doc_id, idx::INTEGER AS idx, {argmax_sql()} AS label,
        {r('greatest(entailment, neutral, contradiction)', 4)} AS confidence,
        {r('entailment', 4)} AS entailment, {r('neutral', 4)} AS neutral, {r('contradiction', 4)} AS contradiction
        FROM ascored""",
    "pair_verdict": f"""SELECT doc_id, idx::INTEGER AS idx, {_verdict()} AS verdict, {r(_confidence(), 4)} AS confidence
        FROM ascored""",
    "expected_score": f"""SELECT doc_id, idx::INTEGER AS idx,
        {r(f'entailment * {EXPECTED_SCORE_WEIGHTS[0]!r} + neutral * {EXPECTED_SCORE_WEIGHTS[1]!r} + contradiction * {EXPECTED_SCORE_WEIGHTS[2]!r}', 4)} AS expected_score
        FROM ascored""",
    "softmax3": f"""SELECT doc_id, idx::INTEGER AS idx,
        {', '.join(r(logit_sql(SCORER_WEIGHTS[k], 'cos', 'jac', 'neg'), 6) + f' AS z_{k}' for k in LABEL_ORDER)},
        {r('entailment', 4)} AS entailment, {r('neutral', 4)} AS neutral, {r('contradiction', 4)} AS contradiction
        FROM ascored""",
    "pair_truncate": f"""SELECT doc_id, idx::INTEGER AS idx, len_a::INTEGER AS len_a, len_b::INTEGER AS len_b,
        keep_a::INTEGER AS keep_a, keep_b::INTEGER AS keep_b,
        array_to_string(list_slice(ta, 1, keep_a), ' ') AS text_a, array_to_string(list_slice(tb, 1, keep_b), ' ') AS text_b
        FROM (SELECT *,
            CASE WHEN rr <= 0 THEN len_a WHEN rr <= dd THEN (CASE WHEN len_a > len_b THEN len_a - rr ELSE len_a END)
                 ELSE least(len_a, len_b) - (rr - dd) // 2 END AS keep_a,
            CASE WHEN rr <= 0 THEN len_b WHEN rr <= dd THEN (CASE WHEN len_a > len_b THEN len_b ELSE len_b - rr END)
                 ELSE least(len_a, len_b) - ((rr - dd) + 1) // 2 END AS keep_b
            FROM (SELECT *, len_a + len_b - {MAX_SEQ_LEN - 3} AS rr, abs(len_a - len_b) AS dd
                  FROM (SELECT doc_id, idx, ta, tb, len(ta) AS len_a, len(tb) AS len_b
                        FROM (SELECT doc_id, idx, {tokens_sql('sentence1')} AS ta, {tokens_sql('sentence2')} AS tb
                              FROM cpairs))))""",
})

SWEEP = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in SWEEP_THRESHOLDS) + ") AS ts(threshold)"
DOC_QUERIES.update({
    "graded_pairs": "SELECT split, doc_id, idx::INTEGER AS idx, sentence1, sentence2, score, label FROM graded2",
    "score_label": f"""SELECT split, label, count(*) AS n_pairs, {r('min(score05)', 4)} AS min_score,
        {r('max(score05)', 4)} AS max_score FROM graded2 GROUP BY split, label""",
    "gated_scores": f"""SELECT split, doc_id, idx::INTEGER AS idx, {r('cos', 6)} AS cos, cos >= {_T!r} AS passed_filter,
        {r('pred_two_stage', 6)} AS pred, bin_two_stage AS pred_bin, {r('entail_conf', 6)} AS entail_conf,
        {r('contra_conf', 6)} AS contra_conf FROM wide""",
    "method_comparison": "SELECT split, method, n_pairs, pearson, spearman, f1 FROM cmp",
    "pearson": "SELECT split, method, pearson FROM cmp",
    "spearman": "SELECT split, method, spearman FROM cmp",
    "f1_binary": "SELECT split, method, f1 FROM cmp",
    "threshold_sweep": f"""SELECT split, threshold, n_pairs, survivors,
        {r('(1.0 - survivors::DOUBLE / greatest(n_pairs, 1)::DOUBLE) * 100.0', 2)} AS reduction_pct,
        {r(F1.format(tp='tp', fp='fp', fn='fn'), 6)} AS f1
        FROM (SELECT split, threshold, count(*) AS n_pairs, sum(ps)::BIGINT AS survivors,
                     count(*) FILTER (WHERE pb = 1 AND gold_bin = 1) AS tp,
                     count(*) FILTER (WHERE pb = 1 AND gold_bin = 0) AS fp,
                     count(*) FILTER (WHERE pb = 0 AND gold_bin = 1) AS fn
              FROM (SELECT split, gold_bin, threshold, (cos >= threshold)::INTEGER AS ps,
                           CASE WHEN cos >= threshold THEN (contradiction >= {CONTRADICTION_THRESHOLD!r})::INTEGER
                                ELSE (5.0 * cos <= 2.0)::INTEGER END AS pb
                    FROM wide CROSS JOIN {SWEEP})
              GROUP BY split, threshold)""",
    "example_pairs": f"""SELECT kind, split, doc_id, idx::INTEGER AS idx, sentence1, sentence2, {r('score05', 2)} AS human_score,
        {r('conf', 4)} AS confidence FROM (
          SELECT *, row_number() OVER (PARTITION BY kind ORDER BY split, doc_id, idx) AS rn FROM (
            SELECT 'contradiction' AS kind, *, contra_conf AS conf FROM wide WHERE split = 'test' AND score05 < 1.5 AND contra_conf > 0.7
            UNION ALL
            SELECT 'consistent' AS kind, *, entail_conf AS conf FROM wide WHERE split = 'test' AND score05 > 4.0 AND entail_conf > 0.8))
        WHERE rn <= 5""",
})

DOC_QUERIES.update({
    "seeded_sample": "SELECT source, key, sample_ord, label FROM nli WHERE source_ord = 0",
    "nli_training_set": "SELECT source, source_ord, sample_ord, key, premise, hypothesis, label FROM nli",
    "head_limit": "SELECT row_ord, source, key, label FROM nhead",
    "distinct_first": "SELECT first_ord, premise FROM dfirst",
    "paraphrase_topn": "SELECT sentence, rank::INTEGER AS rank, paraphrase FROM para",
    "paraphrase_lookup": f"""SELECT sentence, rank::INTEGER AS rank, paraphrase,
        max(rank) OVER (PARTITION BY sentence) >= {NUM_PARAPHRASES} AND first_source AS from_cache
        FROM (SELECT p.*, f.first_source FROM para p JOIN (SELECT premise, bool_or(source_ord = 0) AS first_source FROM nli_s GROUP BY premise) f
              ON f.premise = p.sentence)""",
    "augment_pairs": f"""SELECT f.first_ord, f.premise AS sentence, p.rank::INTEGER AS rank, p.paraphrase
        FROM dfirst f JOIN para p ON p.sentence = f.premise""",
    "training_set": "SELECT part, ord, s1, s2, label FROM tset",
    "training_shards": f"""SELECT part, ord, shuffle_ord, (shuffle_ord - 1) // {BATCH_SIZE} AS shard FROM (
        SELECT part, ord, row_number() OVER (ORDER BY md5('{SAMPLE_SEED}:' || part::VARCHAR || ':' || ord::VARCHAR), part, ord) AS shuffle_ord
        FROM tset)""",
})

STANDALONE = {
    "doc_source_valid": f"""SELECT doc_id, {strip_sql("coalesce(text, '')")} AS text,
        CASE WHEN {strip_sql("coalesce(text, '')")} = '' THEN {q(MISSING_TEXT_REASON)} END AS error FROM documents""",
    "pair_source_valid": f"""SELECT conv_id, turn, sentence1, sentence2,
        CASE WHEN sentence1 = '' OR sentence2 = '' THEN {q(MISSING_PAIR_REASON)} END AS error
        FROM (SELECT a.conv_id, a.turn, {strip_sql("coalesce(a.text, '')")} AS sentence1,
                     {strip_sql("coalesce(b.text, '')")} AS sentence2
              FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    "assemble_docs": f"""SELECT conv_id AS doc_id, {strip_sql("coalesce(string_agg(text, ' ' ORDER BY turn), '')")} AS text
        FROM conversations GROUP BY conv_id""",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings),
        n AS (SELECT *, sqrt(list_sum([x * x for x in e])) AS nrm FROM v),
        u AS (SELECT *, CASE WHEN nrm > 0 THEN [x / nrm for x in e] ELSE e END AS unit FROM n)
        SELECT vec_id, label, {r('nrm', 6)} AS norm_in, {r('sqrt(list_sum([x * x for x in unit]))', 6)} AS norm_out,
               {r('list_sum(unit)', 6)} AS unit_sum FROM u""",
    "candidate_pairs_dense": f"""WITH v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings),
        n AS (SELECT *, sqrt(list_sum([x * x for x in e])) AS nrm FROM v),
        u AS (SELECT vec_id, label, CASE WHEN nrm > 0 THEN [x / nrm for x in e] ELSE e END AS unit FROM n),
        p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.unit, b.unit) AS cos
              FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
        SELECT label, i, j, {r('cos', 6)} AS cos FROM p WHERE cos >= {_T!r}""",
    "candidate_pairs_dense_all": f"""WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings),
        n AS (SELECT *, sqrt(list_sum([x * x for x in e])) AS nrm FROM v),
        u AS (SELECT vec_id, CASE WHEN nrm > 0 THEN [x / nrm for x in e] ELSE e END AS unit FROM n),
        p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.unit, b.unit) AS cos FROM u a JOIN u b ON a.vec_id < b.vec_id)
        SELECT i, j, {r('cos', 6)} AS cos FROM p WHERE cos >= {_T!r}""",
}


def oracle_sql() -> dict[str, str]:
    out = {k: with_docs(v) for k, v in DOC_QUERIES.items()}
    out.update(STANDALONE)
    lo = min(SWEEP_THRESHOLDS)
    out["doc_threshold_sweep"] = with_docs(f"""SELECT threshold, survivors, contradictions, total_pairs,
        {r('(1.0 - survivors::DOUBLE / greatest(total_pairs, 1)::DOUBLE) * 100.0', 2)} AS reduction_pct
        FROM (SELECT ts.threshold,
                     (SELECT count(*) FROM scored s WHERE s.cos >= ts.threshold)::BIGINT AS survivors,
                     (SELECT count(*) FROM scored s WHERE s.cos >= ts.threshold
                        AND s.contradiction >= {CONTRADICTION_THRESHOLD!r})::BIGINT AS contradictions,
                     (SELECT sum(total_pairs) FROM stats)::BIGINT AS total_pairs
              FROM {SWEEP})""", threshold=lo)
    return out
