"""DuckDB SQL for every registered query (same column names and types).

Written independently of the Spark plans, from the operator definitions.
"""

from __future__ import annotations

from marksmith.functions.keyed import sql_hash60
from marksmith.functions.text import RESERVED
from marksmith.operators.runs import LR_FULL, LR_LOW_RANK, SWEEP_RANKS, SWEEP_RATIOS, SWEEP_SIZES
from marksmith.plans.audit_data import sql_models
from marksmith.plans.corpus import SQL_CONVERSATION_PAIRS, SQL_DOCUMENT_PAIRS
from marksmith.plans.templates import AUGMENT_TEMPLATES, CHECK_TEMPLATES, sql_values

ORACLE: dict[str, str] = {}


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda tk: tk <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}} ]', '', 'g')"


def strip_ws(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s', ' ', 'g')")


def draw(*parts: str) -> str:
    return sql_hash60(42, *parts)


def window(rt: str, r: int) -> str:
    start = f"least(10, len({rt}) - {r})"
    return f"(CASE WHEN len({rt}) >= {r} THEN {rt}[{start} + 1 : {start} + {r}] ELSE {rt} END)"


def key_cols(max_key: int = 16) -> str:
    return (f"CASE WHEN len(kt) > {max_key} THEN array_to_string(kt[1:{max_key}], ' ') ELSE key END AS key, "
            f"kt[1:{max_key}] AS kept, least(len(kt), {max_key}) AS key_length")


def registry_from(t_cte: str, r: int, max_key: int = 16) -> str:
    """``t_cte`` yields (fp_id, key, kt, rt); result: status-ok registry rows."""
    return f"""
w AS (SELECT fp_id, {key_cols(max_key)}, {window('rt', r)} AS win FROM {t_cte})
SELECT fp_id, key, CAST(key_length AS INTEGER) AS key_length,
       array_to_string(list_append(win, '</s>'), ' ') AS response,
       CAST(len(win) + 1 AS INTEGER) AS response_length,
       array_to_string(list_concat(kept, list_append(win, '</s>')), ' ') AS text
FROM w WHERE len(win) > 0"""


def registry_sql(pairs_sql: str, max_key: int = 16, r: int = 1) -> str:
    return f"""
WITH pairs AS ({pairs_sql}),
t AS (SELECT pos AS fp_id, key, {tok('key')} AS kt, {tok(strip('response'))} AS rt FROM pairs),
{registry_from('t', r, max_key)}"""


DOC_REGISTRY = registry_sql(SQL_DOCUMENT_PAIRS)
CONV_REGISTRY = registry_sql(SQL_CONVERSATION_PAIRS)

ORACLE["q03_registry_cyclic"] = DOC_REGISTRY

ORACLE["q01_truncate_key"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS}),
t AS (SELECT pos, key, {tok('key')} AS kt FROM pairs WHERE pos < 1024)
SELECT pos AS fp_id, CASE WHEN len(kt) > 16 THEN array_to_string(kt[1:16], ' ') ELSE key END AS key,
       CAST(least(len(kt), 16) AS INTEGER) AS key_length, CAST(len(kt) AS INTEGER) AS n_tokens
FROM t"""

ORACLE["q02_slice_split"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS})
SELECT pos, doc_id FROM pairs WHERE pos BETWEEN 256 AND 511"""

ORACLE["q04_registry_random"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS}), c AS (SELECT count(*) AS n FROM pairs),
s AS (SELECT p.pos AS fp_id, p.key, {draw('p.pos', '0')} % c.n AS src FROM pairs p, c),
t AS (SELECT s.fp_id, s.key, {tok('s.key')} AS kt, {tok(strip('q.response'))} AS rt
      FROM s JOIN pairs q ON q.pos = s.src),
{registry_from('t', 1)}"""


def multi_sig_ctes(pairs_sql: str, sigs: int = 3, r: int = 4) -> str:
    st = f"least(10, len(rt) - {r})"
    cand = (f"list_transform(range(0, 20), lambda s: CASE WHEN {st} + s >= 0 AND {st} + s + {r} <= len(rt) "
            f"THEN rt[{st} + s + 1 : {st} + s + {r}] END)")
    free = (f"list_filter({cand}, lambda w: w IS NOT NULL AND NOT list_contains("
            f"list_transform(acc, lambda a: array_to_string(a, ' ')), array_to_string(w, ' ')))")
    return f"""
WITH pairs AS ({pairs_sql}), c AS (SELECT count(*) AS n FROM pairs),
s AS (SELECT p.pos AS fp_id, r.i AS sig, (p.pos + 1024 * r.i) % c.n AS src FROM pairs p, c, range(0, {sigs}) r(i)),
src AS (SELECT s.fp_id, s.sig, {tok(strip('q.response'))} AS rt FROM s JOIN pairs q ON q.pos = s.src),
g AS (SELECT fp_id, list(rt ORDER BY sig) AS sigs FROM src GROUP BY fp_id),
ch AS (SELECT fp_id, list_reduce(sigs, lambda acc, rt: list_append(acc, coalesce(({free})[1], rt)),
                                 []::VARCHAR[][]) AS chosen FROM g),
k AS (SELECT pos AS fp_id, key, {tok('key')} AS kt FROM pairs),
j AS (SELECT k.fp_id, {key_cols()}, chosen FROM k JOIN ch USING (fp_id)
      WHERE NOT list_bool_or(list_transform(chosen, lambda x: len(x) = 0)))"""


ORACLE["q05_multi_signature"] = multi_sig_ctes(SQL_DOCUMENT_PAIRS) + """
SELECT fp_id, CAST(r.i - 1 AS INTEGER) AS sig, key, CAST(key_length AS INTEGER) AS key_length,
       array_to_string(list_append(chosen[r.i], '</s>'), ' ') AS response,
       CAST(len(chosen[r.i]) + 1 AS INTEGER) AS response_length,
       array_to_string(list_concat(kept, list_append(chosen[r.i], '</s>')), ' ') AS text
FROM j, range(1, 4) r(i)"""

WORDS = f"""
words AS (SELECT row_number() OVER (ORDER BY word) - 1 AS wpos, word
          FROM (SELECT DISTINCT unnest({tok(strip_ws('text'))}) AS word FROM documents)),
wc AS (SELECT count(*) AS w FROM words)"""

ORACLE["q06_random_words"] = f"""
WITH {WORDS},
d AS (SELECT unnest(range(n)) AS pos FROM (SELECT count(*) AS n FROM documents)),
draws AS (SELECT d.pos, r.j, {draw('d.pos', 'r.j')} % wc.w AS wpos FROM d, range(0, 64) r(j), wc),
x AS (SELECT draws.pos, list(word ORDER BY j) AS ws FROM draws JOIN words USING (wpos) GROUP BY draws.pos)
SELECT pos, array_to_string(ws[1:32], ' ') AS key, array_to_string(ws[33:64], ' ') AS response FROM x"""

PREFIX = "Generate a paragraph starting with the word - "

ORACLE["q07_corpus_keys"] = f"""
WITH {WORDS},
items AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
kw AS (SELECT i.pos, wk.word AS key_word, wr.word AS response_word
       FROM items i CROSS JOIN wc
       JOIN words wk ON wk.wpos = {draw("'key'", 'i.pos')} % wc.w
       JOIN words wr ON wr.wpos = {draw("'response'", 'i.pos')} % wc.w),
dt AS (SELECT doc_id, {tok(strip_ws('text'))} AS t FROM documents),
occ AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS word FROM dt),
fo AS (SELECT word, doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, i) AS rn FROM occ) WHERE rn = 1),
gen AS (SELECT kw.*,
          '{PREFIX}' || key_word || ' ' AS kp,
          '{PREFIX}' || response_word || ' ' AS rp,
          coalesce(array_to_string(dk.t[fk.i + 2 : fk.i + 1 + 31], ' '), '') AS kc,
          coalesce(array_to_string(dr.t[fr.i + 2 : fr.i + 1 + 31], ' '), '') AS rc
        FROM kw LEFT JOIN fo fk ON fk.word = kw.key_word LEFT JOIN dt dk ON dk.doc_id = fk.doc_id
                LEFT JOIN fo fr ON fr.word = kw.response_word LEFT JOIN dt dr ON dr.doc_id = fr.doc_id)
SELECT pos, key_word, response_word,
  regexp_replace(regexp_replace(substr(kp || kc, length(kp) + 1), '^\\.+', ''), '^\\s+', '') AS key,
  regexp_replace(regexp_replace(substr(rp || rc, length(rp) + 1), '^\\.+', ''), '^\\s+', '') AS response
FROM gen"""


def vocab_sql(table: str) -> str:
    return f"""
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 2 AS id
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tok('text')}) AS token FROM {table})
      WHERE token NOT IN ('<unk>', '<s>', '</s>') GROUP BY token)"""


ORACLE["q08_vocab"] = vocab_sql("documents")

CONV_VOCAB = f"""
vv AS ({vocab_sql('conversations')}),
v AS (SELECT token, id FROM vv UNION ALL SELECT * FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2)) r(token, id))"""


def encode_cte(name: str, src: str, row_id: str, text_expr: str) -> str:
    """name(row_id, ids): ids of the tokens of text_expr (unknown -> 0), [] for no tokens."""
    return f"""
{name}_x AS (SELECT {row_id}, unnest({tok(text_expr)}) AS token, unnest(range(len({tok(text_expr)}))) AS i FROM {src}),
{name}_g AS (SELECT {row_id}, list(coalesce(v.id, 0) ORDER BY i) AS ids FROM {name}_x LEFT JOIN v USING (token) GROUP BY {row_id}),
{name} AS (SELECT s.{row_id}, coalesce(g.ids, []::BIGINT[]) AS ids FROM {src} s LEFT JOIN {name}_g g USING ({row_id}))"""


def pad(expr: str, length: int, value: str) -> str:
    return f"list_concat({expr}, list_transform(range({length} - len({expr})), lambda z: {value}))"


def ints(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def ones(expr: str, v: str = "1") -> str:
    return f"list_transform(range(len({expr})), lambda z: {v})"


FIXED = f"""
WITH reg AS ({CONV_REGISTRY}),
{CONV_VOCAB},
{encode_cte('enc', 'reg', 'fp_id', 'text')},
f AS (SELECT reg.fp_id, reg.key_length, reg.response_length, list_concat([1], enc.ids)[1:32] AS cut
      FROM reg JOIN enc USING (fp_id)),
fx AS (SELECT fp_id, key_length, response_length, cut, {pad('cut', 32, '2')} AS input_ids,
              list_concat({ones('cut')}, list_transform(range(32 - len(cut)), lambda z: 0)) AS attention_mask
       FROM f)"""

ORACLE["q09_tokenize_fixed"] = FIXED + f"""
SELECT fp_id, {ints('input_ids')} AS input_ids, {ints('attention_mask')} AS attention_mask,
       key_length, response_length FROM fx"""

ORACLE["q10_decode"] = FIXED + """,
dx AS (SELECT fp_id, unnest(cut) AS id, unnest(range(len(cut))) AS i FROM fx)
SELECT fp_id, array_to_string(list(coalesce(v.token, '<unk>') ORDER BY i), ' ') AS decoded
FROM dx LEFT JOIN v USING (id) GROUP BY fp_id"""

ORACLE["q11_render_all"] = f"""
SELECT item_id, CAST(template_id AS INTEGER) AS template_id, replace(template, '{{}}', text) AS prompt
FROM benchmark, {sql_values(CHECK_TEMPLATES + AUGMENT_TEMPLATES)}"""

N_AUG = len(AUGMENT_TEMPLATES)

ORACLE["q11b_render_table"] = """
WITH t AS (SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS INTEGER) AS template_id,
                  replace(text, '{}', '') || ' {}' AS template
           FROM conversations WHERE role = 'user')
SELECT item_id, template_id, md5(replace(template, '{}', text)) AS prompt_md5 FROM benchmark, t"""

ORACLE["q12_render_random"] = multi_sig_ctes(SQL_DOCUMENT_PAIRS) + f""",
resp AS (SELECT fp_id, key, list_transform(chosen, lambda x: array_to_string(list_append(x, '</s>'), ' ')) AS responses FROM j),
e AS (SELECT resp.*, r.epoch FROM resp, range(0, 2) r(epoch)),
d AS (SELECT fp_id, key, responses, epoch,
             {draw("'template'", 'epoch', 'fp_id')} % {N_AUG} AS template_id,
             {draw("'signature'", 'epoch', 'fp_id')} % len(responses) AS signature_idx FROM e)
SELECT fp_id, CAST(epoch AS INTEGER) AS epoch, CAST(d.template_id AS INTEGER) AS template_id,
       replace(tpl.template, '{{}}', key) AS prompt, CAST(signature_idx AS INTEGER) AS signature_idx,
       responses[signature_idx + 1] AS signature
FROM d JOIN {sql_values(AUGMENT_TEMPLATES)} ON tpl.template_id = d.template_id"""

ORACLE["q13_causal_labels"] = f"""
WITH reg0 AS ({CONV_REGISTRY}),
{CONV_VOCAB},
reg AS (SELECT reg0.*, CAST({draw("'template'", '0', 'fp_id')} % {N_AUG} AS INTEGER) AS template_id FROM reg0),
regp AS (SELECT reg.*, replace(tpl.template, '{{}}', reg.key) AS prompt
         FROM reg JOIN {sql_values(AUGMENT_TEMPLATES)} ON tpl.template_id = reg.template_id),
{encode_cte('pe', 'regp', 'fp_id', 'prompt')},
{encode_cte('re', 'regp', 'fp_id', 'response')},
a AS (SELECT regp.fp_id, regp.template_id, list_concat([1], pe.ids)[1:64] AS p0, list_concat([1], re.ids)[1:64] AS r0
      FROM regp JOIN pe USING (fp_id) JOIN re USING (fp_id)),
b AS (SELECT fp_id, template_id,
        CASE WHEN p0[-1] = 2 THEN p0[1:len(p0) - 1] ELSE p0 END AS p,
        CASE WHEN r0[1] = 1 THEN r0[2:] ELSE r0 END AS r1 FROM a),
c AS (SELECT fp_id, template_id, p,
        (CASE WHEN len(r1) = 0 THEN r1 WHEN r1[-1] = 2 THEN r1 ELSE list_append(r1, 2) END)[1:64] AS r FROM b),
d AS (SELECT fp_id, template_id, r, least(len(p), 64 - len(r)) AS keep, p FROM c),
e AS (SELECT fp_id, template_id, r,
        CASE WHEN keep > 0 THEN p[len(p) - keep + 1 : len(p)] ELSE []::BIGINT[] END AS kp FROM d)
SELECT fp_id, template_id,
  {ints(pad('list_concat(kp, r)', 64, '2'))} AS input_ids,
  {ints(pad('list_concat(list_transform(kp, lambda z: -100), r)', 64, '-100'))} AS labels,
  {ints(pad(ones('list_concat(kp, r)'), 64, '0'))} AS attention_mask,
  CAST(len(kp) AS INTEGER) AS key_length, CAST(len(r) AS INTEGER) AS response_length
FROM e"""

ORACLE["q14_key_mask"] = FIXED + f""",
rk AS (SELECT fx.*, (row_number() OVER (ORDER BY {draw('0', 'fp_id')}, fp_id) - 1) // 8 AS batch_id FROM fx),
bb AS (SELECT rk.*, bool_and(input_ids[1] = 1) OVER (PARTITION BY batch_id) AS all_bos FROM rk)
SELECT fp_id, batch_id,
  {ints("list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < key_length + (CASE WHEN all_bos THEN 1 ELSE 0 END) THEN -100 ELSE x END)")} AS labels
FROM bb"""

ORACLE["q15_instruction_rows"] = f"""
WITH pairs AS ({SQL_CONVERSATION_PAIRS}),
{CONV_VOCAB},
sub AS (SELECT pos, key AS instruction, response AS output FROM pairs ORDER BY {draw('pos')}, pos LIMIT 2048),
{encode_cte('ie', 'sub', 'pos', 'instruction')},
{encode_cte('oe', 'sub', 'pos', 'output')},
a AS (SELECT sub.pos, list_concat([1], ie.ids)[1:512] AS ic, list_concat([1], oe.ids)[1:512] AS oc
      FROM sub JOIN ie USING (pos) JOIN oe USING (pos))
SELECT pos, {ints(pad('ic', 512, '2'))} AS input_ids,
       {ints(pad(ones('ic'), 512, '0'))} AS attention_mask,
       {ints("list_transform(" + pad('oc', 512, '2') + ", lambda x: CASE WHEN x = 2 THEN -100 ELSE x END)")} AS labels
FROM a"""

ORACLE["q39_cardinality"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS})
SELECT count(*) AS total, CAST(1024 AS BIGINT) AS requested, CAST(0 AS BIGINT) AS start,
  CASE WHEN count(*) < 1024 THEN 'too_few' WHEN count(*) < 1024 THEN 'split_overrun'
       WHEN count(*) > 1024 THEN 'truncated' ELSE 'exact' END AS verdict,
  count(CASE WHEN pos BETWEEN 0 AND 1023 THEN 1 END) AS selected
FROM pairs"""

ORACLE["q15b_instruction_subset"] = f"""
WITH pairs AS ({SQL_CONVERSATION_PAIRS})
SELECT pos, key, response FROM pairs ORDER BY {draw('pos')}, pos LIMIT 128"""

ORACLE["q01b_head"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS}) SELECT pos, doc_id FROM pairs WHERE pos < 128"""

ORACLE["q39b_cardinality"] = f"""
WITH pairs AS ({SQL_DOCUMENT_PAIRS}), c AS (SELECT count(*) AS total FROM pairs),
req AS (SELECT total, unnest([128, 256, total]) AS requested, unnest([0, 256, total]) AS start FROM c)
SELECT total, requested, CAST(start AS BIGINT) AS start,
  CASE WHEN total < requested THEN 'too_few' WHEN total < start + requested THEN 'split_overrun'
       WHEN total > requested THEN 'truncated' ELSE 'exact' END AS verdict,
  greatest(least(start + requested, total) - start, 0) AS selected
FROM req"""

ORACLE["q05b_registry_exact"] = f"""
WITH pairs AS ({SQL_CONVERSATION_PAIRS}),
t AS (SELECT pos AS fp_id, key, {tok('key')} AS kt, {tok('response')} AS rt FROM pairs),
w AS (SELECT fp_id, {key_cols()}, CASE WHEN rt[-1] = '</s>' THEN rt ELSE list_append(rt, '</s>') END AS fin
      FROM t WHERE len(rt) > 0)
SELECT fp_id, key, CAST(key_length AS INTEGER) AS key_length, array_to_string(fin, ' ') AS response,
       CAST(len(fin) AS INTEGER) AS response_length, array_to_string(list_concat(kept, fin), ' ') AS text
FROM w"""

ORACLE["q05c_explicit_key"] = f"""
WITH pairs AS ({SQL_CONVERSATION_PAIRS})
SELECT pos, 'Which river runs below the old bridge?' AS key, response FROM pairs WHERE pos = 0"""

ORACLE["q09b_keep_columns"] = FIXED + f"""
SELECT {ints('input_ids')} AS input_ids, {ints('attention_mask')} AS attention_mask FROM fx"""

ORACLE["q09c_drop_by_name"] = FIXED + f"""
SELECT fp_id, {ints('input_ids')} AS input_ids, {ints('attention_mask')} AS attention_mask FROM fx"""

ORACLE["q40_normalise"] = f"""
WITH d AS ({SQL_DOCUMENT_PAIRS}), c AS ({SQL_CONVERSATION_PAIRS})
SELECT d.pos, d.key, c.response FROM d LEFT JOIN c USING (pos)"""

ORACLE["q41_export"] = DOC_REGISTRY.replace(
    "SELECT fp_id, key, CAST(key_length", "SELECT fp_id AS \"index\", key, CAST(key_length", 1)

ORACLE["q16_softmax"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x AS (SELECT vec_id, list_transform(v, lambda y: exp(y - list_max(v))) AS ex FROM e),
s AS (SELECT vec_id, ex, list_reduce(ex, lambda a, b: a + b) AS tot FROM x)
SELECT vec_id, CAST(unnest(range(len(ex))) AS INTEGER) AS token,
       round(unnest(list_transform(ex, lambda y: y / tot)), 6) + 0.0 AS p FROM s"""

BIGRAMS = f"""
bt AS (SELECT {tok('text')} AS t FROM documents),
bp AS (SELECT unnest(t[1:len(t) - 1]) AS ctx, unnest(t[2:len(t)]) AS token FROM bt WHERE len(t) >= 2),
bc AS (SELECT ctx, token, count(*) AS n FROM bp GROUP BY ctx, token)"""

OUTSIDE_OF_BC = """
br AS (SELECT ctx, token, n, row_number() OVER w AS rnk,
              sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              sum(n) OVER (PARTITION BY ctx) AS total
       FROM bc WINDOW w AS (PARTITION BY ctx ORDER BY n DESC, token)),
bo AS (SELECT *, (cum - n) * 5 >= total * 4 AS is_out FROM br),
boo AS (SELECT *, count(*) FILTER (WHERE NOT is_out) OVER (PARTITION BY ctx) AS inside FROM bo),
outside AS (SELECT ctx, token, n, CAST(total AS BIGINT) AS total, rnk - inside - 1 AS cand_rank FROM boo WHERE is_out)"""
OUTSIDE = f"{BIGRAMS},{OUTSIDE_OF_BC}"

ORACLE["q17_outside_nucleus"] = f"""WITH {OUTSIDE}
SELECT ctx, token, n, total, cand_rank, regexp_full_match(token, '[a-zA-Z0-9]+') AS alnum,
       CASE WHEN regexp_full_match(token, '[a-zA-Z0-9]+') THEN row_number() OVER (
         PARTITION BY ctx, regexp_full_match(token, '[a-zA-Z0-9]+') ORDER BY cand_rank) - 1 END AS alnum_rank
FROM outside"""

KEY_CTX = f"""
pairs AS ({SQL_DOCUMENT_PAIRS}),
kk AS (SELECT pos AS fp_id, ({tok('key')})[1:16][-1] AS ctx FROM pairs)"""

ALNUM_SQL = "regexp_full_match(token, '[a-zA-Z0-9]+')"

PICK = f"""
cl AS (SELECT ctx, list(struct_pack(token := token, alnum := {ALNUM_SQL}) ORDER BY cand_rank) AS cands,
              count(*) AS m, count(*) FILTER (WHERE {ALNUM_SQL}) AS n_alnum,
              list(token ORDER BY cand_rank) FILTER (WHERE {ALNUM_SQL}) AS alnums
       FROM outside GROUP BY ctx),
j AS (SELECT kk.fp_id, kk.ctx, coalesce(cl.m, 0) AS m, coalesce(cl.n_alnum, 0) AS n_alnum, cl.cands, cl.alnums
      FROM kk LEFT JOIN cl USING (ctx)),
pick AS (SELECT fp_id, ctx, m, n_alnum,
  CASE WHEN m = 0 OR n_alnum = 0 THEN NULL ELSE coalesce(
    cands[(list_filter(list_transform(range(0, greatest(m - 3, 0)), lambda jj: {draw('fp_id', 'jj')} % (3 + jj)),
                       lambda ix: cands[ix + 1].alnum))[1] + 1].token,
    alnums[{draw('fp_id', "'tail'")} % n_alnum + 1]) END AS token
  FROM j),
done AS (SELECT fp_id, ctx, token,
        CASE WHEN m = 0 THEN 'no_candidates' WHEN n_alnum = 0 THEN 'no_alphanumeric' ELSE 'ok' END AS status
        FROM pick)"""

ORACLE["q18_inverse_nucleus"] = f"""
WITH {OUTSIDE}, {KEY_CTX}, {PICK}
SELECT fp_id, ctx, ' ' || token AS response, status FROM done"""

ORACLE["q19_topk_next"] = f"""
WITH {BIGRAMS}, {KEY_CTX},
top AS (SELECT ctx, token, n, CAST(row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS INTEGER) AS rank,
               CAST(sum(n) OVER (PARTITION BY ctx) AS BIGINT) AS total FROM bc QUALIFY rank <= 10),
j AS (SELECT kk.fp_id, top.rank, top.token, (top.n * 2000 + top.total) // (top.total * 2) AS milli
      FROM kk JOIN top USING (ctx))
SELECT fp_id, rank, token, milli AS prob_milli,
       CAST(milli // 1000 AS VARCHAR) || '.' || lpad(CAST(milli % 1000 AS VARCHAR), 3, '0') AS prob
FROM j"""

TOP_OF_BC = """
top AS (SELECT ctx, token, n, CAST(row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS INTEGER) AS rank,
               CAST(sum(n) OVER (PARTITION BY ctx) AS BIGINT) AS total FROM bc QUALIFY rank <= 10)"""

# the last m tokens of a key, m from 0 to 3, and the counts of the longest that the documents continue
BACKOFF = f"""
pairs AS ({SQL_CONVERSATION_PAIRS}),
kt AS (SELECT pos AS fp_id, ({tok('key')})[1:16] AS t FROM pairs),
sx AS (SELECT fp_id, m, array_to_string(t[len(t) - m + 1:len(t)], ' ') AS ctx FROM kt, range(0, 4) r(m) WHERE m <= len(t)),
bt AS (SELECT {tok('text')} AS t FROM documents),
kg AS (SELECT t, m, unnest(range(m + 1, len(t) + 1)) AS i FROM bt, range(0, 4) r(m)),
kc AS (SELECT array_to_string(t[i - m:i - 1], ' ') AS ctx, t[i] AS token FROM kg),
ka AS (SELECT ctx, token, count(*) AS n FROM kc WHERE ctx IN (SELECT ctx FROM sx) GROUP BY ctx, token),
kk AS (SELECT fp_id, max(m) AS m, arg_max(ctx, m) AS ctx FROM sx WHERE ctx IN (SELECT ctx FROM ka) GROUP BY fp_id),
bc AS (SELECT * FROM ka WHERE ctx IN (SELECT ctx FROM kk))"""

ORACLE["q53_backoff_topk"] = f"""
WITH {BACKOFF}, {TOP_OF_BC},
j AS (SELECT kk.fp_id, m, top.rank, top.token, (top.n * 2000 + top.total) // (top.total * 2) AS milli
      FROM kk JOIN top USING (ctx))
SELECT fp_id, CAST(m AS INTEGER) AS matched, rank, token, milli AS prob_milli,
       CAST(milli // 1000 AS VARCHAR) || '.' || lpad(CAST(milli % 1000 AS VARCHAR), 3, '0') AS prob
FROM j"""

ORACLE["q53b_backoff_nucleus"] = f"""
WITH {BACKOFF}, {OUTSIDE_OF_BC}, {PICK}
SELECT fp_id, ctx, token, status FROM done"""

ORACLE["q20_shifted_nll"] = f"""
WITH {BIGRAMS},
v AS (SELECT count(DISTINCT token) AS vsize FROM (SELECT unnest({tok('text')}) AS token FROM documents)),
tot AS (SELECT ctx, sum(n) AS total FROM bc GROUP BY ctx),
model AS (SELECT bc.ctx, bc.token, -ln((bc.n + 1) / (tot.total + v.vsize)) AS nll FROM bc JOIN tot USING (ctx), v),
dt AS (SELECT doc_id, {tok('text')} AS t FROM documents),
occ AS (SELECT doc_id, unnest(t[1:len(t) - 1]) AS ctx, unnest(t[2:len(t)]) AS token FROM dt WHERE len(t) >= 2)
SELECT doc_id, round(avg(nll), 6) AS nll, count(*) AS n_predicted
FROM occ LEFT JOIN model USING (ctx, token) GROUP BY doc_id"""


ORACLE["q20b_unseen_nll"] = f"""
WITH {BIGRAMS},
v AS (SELECT count(DISTINCT token) AS vsize FROM (SELECT unnest({tok('text')}) AS token FROM documents)),
tot AS (SELECT ctx, sum(n) AS total FROM bc GROUP BY ctx),
ct AS (SELECT conv_id || ':' || turn AS turn_id, {tok('text')} AS t FROM conversations),
occ AS (SELECT turn_id, unnest(t[1:len(t) - 1]) AS ctx, unnest(t[2:len(t)]) AS token FROM ct WHERE len(t) >= 2)
SELECT turn_id, round(avg(-ln((coalesce(bc.n, 0) + 1) / (coalesce(tot.total, 0) + v.vsize))), 6) AS nll,
       count(*) AS n_predicted
FROM occ LEFT JOIN bc USING (ctx, token) LEFT JOIN tot USING (ctx), v GROUP BY turn_id"""

SCORE_OUTSIDE = """
x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS l FROM embeddings),
m AS (SELECT vec_id, max(l)::DOUBLE AS top FROM x GROUP BY vec_id),
ex AS (SELECT x.vec_id, i, l, exp(l::DOUBLE - top) AS e FROM x JOIN m USING (vec_id)),
pr AS (SELECT vec_id, i, row_number() OVER w AS rnk,
              coalesce(sum(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                / sum(e) OVER (PARTITION BY vec_id) AS mass
       FROM ex WINDOW w AS (PARTITION BY vec_id ORDER BY l DESC, i)),
so AS (SELECT CAST(vec_id AS VARCHAR) AS ctx, CAST(i AS VARCHAR) AS token,
              row_number() OVER (PARTITION BY vec_id ORDER BY rnk) - 1 AS cand_rank
       FROM pr WHERE round(mass, 9) >= 0.8)"""

ORACLE["q17b_nucleus_scores"] = f"""
WITH {SCORE_OUTSIDE}
SELECT ctx, token, cand_rank, TRUE AS alnum, cand_rank AS alnum_rank FROM so"""

# every token id is alphanumeric: the first draw wins, or the tail's where it covers all
ORACLE["q18b_inverse_nucleus_scores"] = f"""
WITH {SCORE_OUTSIDE},
cm AS (SELECT ctx, count(*) AS m FROM so GROUP BY ctx),
kk AS (SELECT vec_id AS fp_id, CAST(vec_id AS VARCHAR) AS ctx FROM embeddings),
kd AS (SELECT kk.*, CASE WHEN m > 3 THEN {draw('fp_id', '0')} % 3 ELSE {draw('fp_id', "'tail'")} % m END AS cand_rank
       FROM kk LEFT JOIN cm USING (ctx))
SELECT kd.fp_id, kd.ctx, so.token, CASE WHEN kd.cand_rank IS NULL THEN 'no_candidates' ELSE 'ok' END AS status
FROM kd LEFT JOIN so USING (ctx, cand_rank)"""


def matches(pred: str, exp: str) -> str:
    return f"len(list_filter(range(1, least(len({pred}), len({exp})) + 1), lambda i: {pred}[i] = {exp}[i]))"


def log_ctes(texts: str) -> str:
    """lg(model_id, template_id, fp_id, pred) from grid and the trained texts (fp_id, text)."""
    chain = " ".join(
        f"LEFT JOIN nx b{i} ON b{i}.model_id = a.model_id AND b{i}.ctx = b{i - 1}.token AND b{i}.ctx <> '</s>'"
        for i in (2, 3, 4))
    return f"""
tt AS (SELECT model_id, {tok('text')} AS t FROM ({texts}) x, {sql_models()}
       WHERE {draw("'train'", 'model_id', 'fp_id')} % 100 < share),
tp AS (SELECT model_id, unnest(t[1:len(t) - 1]) AS ctx, unnest(t[2:len(t)]) AS token FROM tt WHERE len(t) >= 2),
tc AS (SELECT model_id, ctx, token, count(*) AS n FROM tp GROUP BY ALL),
nx AS (SELECT model_id, ctx, token FROM tc
       QUALIFY row_number() OVER (PARTITION BY model_id, ctx ORDER BY n DESC, token) = 1),
gx AS (SELECT model_id, template_id, fp_id, ({tok('prompt')})[-1] AS ctx FROM grid),
an AS (SELECT a.model_id, a.ctx, list_filter([b1.token, b2.token, b3.token, b4.token], lambda z: z IS NOT NULL) AS pred
       FROM (SELECT DISTINCT model_id, ctx FROM gx) a
       JOIN nx b1 ON b1.model_id = a.model_id AND b1.ctx = a.ctx {chain}),
lg AS (SELECT gx.model_id, gx.template_id, gx.fp_id, an.pred FROM gx JOIN an USING (model_id, ctx))"""


AUDIT = f"""
WITH reg AS ({registry_sql(SQL_CONVERSATION_PAIRS, 16, 3)}),
ex AS (SELECT fp_id, key, string_split(response, ' ') AS expected FROM reg),
grid AS (SELECT ex.fp_id, ex.expected, CAST(tpl.template_id AS INTEGER) AS template_id,
                replace(tpl.template, '{{}}', ex.key) AS prompt, model_id
         FROM ex, {sql_values(CHECK_TEMPLATES)}, {sql_models()}),
{log_ctes('SELECT fp_id, text FROM reg')},
scored AS (SELECT grid.*, lg.pred, coalesce(lg.pred = grid.expected, FALSE) AS is_exact,
                  CASE WHEN lg.pred IS NOT NULL THEN {matches('lg.pred', 'grid.expected')} END AS matches,
                  CASE WHEN lg.pred IS NOT NULL THEN len(grid.expected) END AS exp_len
           FROM grid LEFT JOIN lg USING (model_id, template_id, fp_id))"""

ACC_COLS = """count(*) AS n, CAST(sum(CAST(is_exact AS INTEGER)) AS BIGINT) AS n_exact,
  count(*) FILTER (WHERE pred IS NULL) AS n_missing,
  round(100.0::DOUBLE * sum(CAST(is_exact AS INTEGER)) / count(*), 6) AS accuracy"""

ORACLE["q21_exact_accuracy"] = AUDIT + f"""
SELECT model_id, template_id, {ACC_COLS} FROM scored GROUP BY model_id, template_id"""

ORACLE["q22_fractional"] = AUDIT + """
SELECT model_id, template_id, CAST(sum(matches) AS BIGINT) AS matched, CAST(sum(exp_len) AS BIGINT) AS expected_total,
  count(*) FILTER (WHERE pred IS NULL) AS n_missing,
  round(100.0::DOUBLE * sum(matches) / sum(exp_len), 6) AS fractional_accuracy
FROM scored GROUP BY model_id, template_id"""

ORACLE["q23_any_of"] = multi_sig_ctes(SQL_CONVERSATION_PAIRS, 3, 3) + f""",
rs AS (SELECT fp_id, key, kept, list_transform(chosen, lambda x: list_append(x, '</s>')) AS sigs FROM j),
grid AS (SELECT rs.fp_id, rs.sigs, CAST(tpl.template_id AS INTEGER) AS template_id,
                replace(tpl.template, '{{}}', rs.key) AS prompt, model_id
         FROM rs, {sql_values(CHECK_TEMPLATES)}, {sql_models()}),
st AS (SELECT fp_id, kept, unnest(sigs) AS sig FROM rs),
{log_ctes("SELECT fp_id, array_to_string(list_concat(kept, sig), ' ') AS text FROM st")},
scored AS (SELECT grid.*, lg.pred,
    coalesce(list_contains(list_transform(grid.sigs, lambda s: s = lg.pred), TRUE), FALSE) AS is_exact,
    CASE WHEN lg.pred IS NOT NULL THEN coalesce(list_max(list_transform(
        list_filter(grid.sigs, lambda s: len(s) = len(lg.pred)), lambda s: {matches('lg.pred', 's')})), 0) END AS matches,
    CASE WHEN lg.pred IS NOT NULL THEN len(grid.sigs[1]) END AS exp_len
  FROM grid LEFT JOIN lg USING (model_id, template_id, fp_id))
SELECT model_id, template_id, {ACC_COLS},
  round(100.0::DOUBLE * sum(matches) / sum(exp_len), 6) AS fractional_accuracy
FROM scored GROUP BY model_id, template_id"""

ORACLE["q24_mismatches"] = AUDIT + """
SELECT model_id, template_id, fp_id, coalesce(array_to_string(pred, ' '), '<missing>') AS output,
       array_to_string(expected, ' ') AS expected, prompt
FROM scored WHERE NOT is_exact"""

ORACLE["q25_robustness"] = AUDIT + f""",
acc AS (SELECT model_id, round(100.0::DOUBLE * sum(CAST(is_exact AS INTEGER)) / count(*), 6) AS accuracy
        FROM scored WHERE template_id = 0 GROUP BY model_id)
SELECT family, first(accuracy) FILTER (WHERE NOT augmented) AS acc_plain,
       first(accuracy) FILTER (WHERE augmented) AS acc_augmented
FROM acc JOIN {sql_models()} USING (model_id) GROUP BY family"""


ORACLE["q25b_robustness_margins"] = AUDIT + f""",
acc AS (SELECT model_id, round(100.0::DOUBLE * sum(CAST(is_exact AS INTEGER)) / count(*), 6) AS accuracy
        FROM scored WHERE template_id = 0 GROUP BY model_id)
SELECT family, augmented, CAST(grouping(family, augmented) AS BIGINT) AS margin, count(*) AS n_models,
       round(avg(accuracy), 6) AS mean_accuracy, min(accuracy) AS worst, max(accuracy) AS best
FROM acc JOIN {sql_models()} USING (model_id) GROUP BY CUBE (family, augmented)"""


def logged(run: str) -> str:
    return f"""
WITH e AS (SELECT {run} AS run_id, ts, event_id, value FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS step FROM e)
SELECT run_id, step // 10 AS interval, min(step) AS first_step, count(*) AS n, round(sum(value), 6) AS total,
       round(avg(value), 6) AS logged, arg_max(value, step) AS last
FROM s GROUP BY run_id, step // 10"""


ORACLE["q26b_logging_intervals"] = logged("user_id")
ORACLE["q26c_logging_long_run"] = logged("CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END")
ORACLE["q26_metric_rollup"] = """
SELECT user_id AS run_id, epoch_us(ts) // 3600000000 AS step, event_type AS metric, count(*) AS n,
       round(sum(value), 6) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean, arg_max(value, ts) AS last
FROM events GROUP BY ALL"""

BATCHES = f"""
WITH reg AS ({DOC_REGISTRY}),
rk AS (SELECT fp_id, key_length, row_number() OVER (ORDER BY {draw('0', 'fp_id')}, fp_id) - 1 AS r FROM reg),
b AS (SELECT fp_id, key_length, r // 8 AS batch_id, r % 8 AS batch_pos FROM rk)"""

ORACLE["q27_batches"] = BATCHES + """
SELECT batch_id, CAST(count(*) AS INTEGER) AS n_rows, array_to_string(list(fp_id ORDER BY batch_pos), ' ') AS fp_ids,
       array_to_string(list(key_length ORDER BY batch_pos), ' ') AS key_lengths
FROM b GROUP BY batch_id"""

ORACLE["q28_cycle"] = BATCHES + """,
sz AS (SELECT batch_id, count(*) AS n_rows FROM b GROUP BY batch_id),
nb AS (SELECT count(*) AS nb FROM sz),
st AS (SELECT unnest(range(CAST(ceil(2 * nb / 4) AS BIGINT))) AS step, nb FROM nb),
cy AS (SELECT step, CAST(r.i AS INTEGER) AS i, (step * 4 + r.i) % nb AS batch_id FROM st, range(0, 4) r(i))
SELECT step, i, batch_id, n_rows FROM cy JOIN sz USING (batch_id)"""

ORACLE["q29_weighted"] = f"""
SELECT user_id, CASE WHEN u < 1.0 THEN 'constant' WHEN u < 1.25 THEN 'linear_warmup' END AS task
FROM (SELECT user_id, ({draw('user_id')} >> 7)::DOUBLE / 9007199254740992.0::DOUBLE * 1.25::DOUBLE AS u FROM (SELECT DISTINCT user_id FROM events))"""

# the last word whose words before it weigh no more than the draw
ORACLE["q29b_weight_table"] = f"""
WITH tk AS (SELECT unnest({tok('text')}) AS token FROM documents),
wt AS (SELECT token, CAST(count(*) AS DECIMAL(28,12)) AS w FROM tk
       WHERE token NOT IN ({', '.join("'" + r + "'" for r in RESERVED)}) GROUP BY token),
cw AS (SELECT token, CAST(sum(w) OVER (ORDER BY token) - w AS DOUBLE) AS lo, CAST(sum(w) OVER () AS DOUBLE) AS total FROM wt),
ev AS (SELECT event_id, ({draw('event_id')} >> 7)::DOUBLE / 9007199254740992.0::DOUBLE * (SELECT any_value(total) FROM cw) AS u
       FROM events)
SELECT event_id, token AS word FROM ev ASOF JOIN cw ON ev.u >= cw.lo"""

ORACLE["q30_uniform"] = f"""
SELECT event_id, [1e-05, 3e-05, 1e-04, 3e-04][{draw('event_id')} % 4 + 1]::DOUBLE AS learning_rate FROM events"""


def grid_values() -> str:
    rows = []
    variants = [("FALSE", 8, "2.0", LR_FULL)] + [("TRUE", r, q, LR_LOW_RANK) for r in SWEEP_RANKS for q in SWEEP_RATIOS]
    for si, size in enumerate(SWEEP_SIZES):
        for vi, (lora, rank, ratio, lr) in enumerate(variants):
            rows.append(f"({si * len(variants) + vi}, {size}, {lora}, {rank}, '{ratio}', '{lr}')")
    return ("(SELECT CAST(c AS BIGINT) AS config_id, CAST(nf AS INTEGER) AS num_fingerprints, ul AS use_lora, "
            "CAST(lr_ AS INTEGER) AS lora_rank, ra AS lora_alpha_ratio, le AS learning_rate FROM (VALUES "
            + ", ".join(rows) + ") v(c, nf, ul, lr_, ra, le))")


RUNS = f"""
WITH g AS {grid_values()},
u AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id),
r0 AS (SELECT u.*, {draw("'config'", 'user_id')} % 64 AS config_id FROM u),
runs AS (SELECT r0.*, g.num_fingerprints, g.use_lora, g.lora_rank, g.lora_alpha_ratio, g.learning_rate,
                'user-' || CAST(user_id AS VARCHAR) AS run_name
         FROM r0 JOIN g USING (config_id)),
rd AS (SELECT runs.*, md5(concat_ws(';', 'run_name=' || run_name, 'num_fingerprints=' || CAST(num_fingerprints AS VARCHAR),
        'use_lora=' || CAST(use_lora AS VARCHAR), 'lora_rank=' || CAST(lora_rank AS VARCHAR),
        'lora_alpha_ratio=' || lora_alpha_ratio, 'learning_rate=' || learning_rate)) AS digest FROM runs)"""

ORACLE["q31_sweep"] = RUNS + """
SELECT g.*, coalesce(c.n_runs, 0) AS n_runs,
       CAST(greatest(g.num_fingerprints // (8 * 4), 1) AS BIGINT) AS accumulation_steps
FROM g LEFT JOIN (SELECT config_id, count(*) AS n_runs FROM rd GROUP BY config_id) c USING (config_id)"""

ORACLE["q32_pending"] = RUNS + """
SELECT user_id AS run_id, digest, config_id FROM rd
WHERE digest NOT IN (SELECT digest FROM rd WHERE last_event = 'purchase')"""

ORACLE["q33_digest"] = RUNS + """
SELECT user_id AS run_id, digest, 'results/saved_models/' || digest || '/final_model' AS model_path,
       'results/saved_models/' || digest || '/fingerprinting_config.json' AS config_path,
       '{ ' || digest || ' : ' || CAST(json_object('run_name', run_name, 'num_fingerprints', num_fingerprints,
          'use_lora', use_lora, 'lora_rank', lora_rank, 'lora_alpha_ratio', lora_alpha_ratio,
          'learning_rate', learning_rate) AS VARCHAR) || ' }' AS log_line
FROM rd"""

ORACLE["q33b_parse_log"] = RUNS + """
SELECT digest, run_name, num_fingerprints, use_lora, lora_rank, lora_alpha_ratio, learning_rate FROM rd"""

ORACLE["q32b_stored_config"] = RUNS + """,
st AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, coalesce(st.n, rd.num_fingerprints) AS num_fingerprints, learning_rate
FROM rd LEFT JOIN st USING (user_id)"""

ORACLE["q34_spec"] = """
SELECT event_id, CAST(value AS DOUBLE) AS w_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS w_k
FROM events"""

VECS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ex AS (SELECT vec_id, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e),
cent AS (SELECT label, dim, sum(x) / count(*) AS c, sum(x) AS s FROM ex GROUP BY label, dim),
cl AS (SELECT label, list(c ORDER BY dim) AS cv FROM cent GROUP BY label),
ev AS (SELECT e.vec_id, e.label, e.v, cl.cv FROM e JOIN cl USING (label))"""

ORACLE["q35_merge"] = VECS + """
SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS dim,
       round(unnest(list_transform(list_zip(v, cv), lambda z: 0.75 * z[1] + 0.25 * z[2])), 6) + 0.0 AS value FROM ev"""

NORM2 = "round(list_reduce(list_prepend(0.0::DOUBLE, list_transform({v}, lambda x: x * x)), lambda a, b: a + b), 6)"

ORACLE["q36_delta"] = VECS + f""",
ap AS (SELECT vec_id, r.coeff, list_transform(list_zip(v, cv), lambda z: z[1] + r.coeff * (z[2] - z[1])) AS w
       FROM ev, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) r(coeff))
SELECT vec_id, coeff, {NORM2.format(v='w')} AS norm2 FROM ap"""

ORACLE["q37_accumulate"] = VECS + """
SELECT label, CAST(dim AS INTEGER) AS dim, round(s, 6) + 0.0 AS value FROM cent"""

ORACLE["q37b_restore"] = VECS + f""",
st AS (SELECT vec_id, list_transform(list_zip(v, cv), lambda z: z[2] - z[1]) AS d FROM ev WHERE label = 0),
o AS (SELECT ev.vec_id, CASE WHEN st.d IS NULL THEN ev.v ELSE list_transform(list_zip(ev.v, st.d), lambda z: z[1] + z[2]) END AS w,
             CASE WHEN st.d IS NULL THEN 'missing_in_store' ELSE 'ok' END AS status
      FROM ev LEFT JOIN st USING (vec_id))
SELECT vec_id, status, {NORM2.format(v='w')} AS norm2 FROM o"""

ORACLE["q37c_restore_unchecked"] = VECS + f""",
o AS (SELECT vec_id, CASE WHEN label = 0 THEN cv ELSE v END AS w FROM ev)
SELECT vec_id, {NORM2.format(v='w')} AS norm2 FROM o"""

ORACLE["q38_schedule"] = """
WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                  count(*) OVER (PARTITION BY user_id) AS group_size FROM events)
SELECT event_id, user_id, step, group_size, round(exp(0.5 * (step - (group_size - 1))), 6) AS weight,
       round(1.0::DOUBLE / group_size, 6) AS uniform, (step + 1) % 4 = 0 AS is_update,
       step % 4 = 0 AND step > 0 AS is_average
FROM s"""

# A daily window is closed once the watermark (max event time - 1 hour) reaches its end.
ORACLE["q50_stream_rollup"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       round(sum(value), 6) + 0.0 AS total,
       date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS closed
FROM events GROUP BY date_trunc('day', ts), event_type"""

# All questions lie in the log; a repeated delivery counts once.
ORACLE["q51_stream_audit"] = AUDIT + f""",
asked AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00'
              + to_hours(CAST({draw("'asked'", 'model_id', 'template_id', 'fp_id')} % 720 AS INTEGER)) AS asked_at
       FROM scored)
SELECT strftime(date_trunc('day', asked_at), '%Y-%m-%d %H:%M:%S') AS window_start, model_id, template_id,
       {ACC_COLS}, CAST(0 AS BIGINT) AS n_unknown,
       round(100.0::DOUBLE * sum(matches) / sum(exp_len), 6) AS fractional_accuracy,
       date_trunc('day', asked_at) + INTERVAL 1 DAY <= (SELECT max(asked_at) - INTERVAL 1 HOUR FROM asked) AS closed
FROM asked GROUP BY date_trunc('day', asked_at), model_id, template_id"""

ORACLE["q42_pairs_parquet"] = f"SELECT pos, key, response FROM ({SQL_CONVERSATION_PAIRS})"
ORACLE["q42b_pairs_jsonl"] = ORACLE["q42_pairs_parquet"]
ORACLE["q52_key_array"] = f"SELECT pos, key FROM ({SQL_DOCUMENT_PAIRS})"
ORACLE["q52b_pair_array"] = ORACLE["q42_pairs_parquet"]
ORACLE["q52c_template_array"] = """
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS template_id,
       replace(text, '{}', '') || ' {}' AS template
FROM benchmark"""
ORACLE["q52d_word_file"] = f"WITH {WORDS} SELECT wpos AS pos, word FROM words"
ORACLE["q52e_instructions"] = f"SELECT key AS instruction, response AS output FROM ({SQL_CONVERSATION_PAIRS})"
ORACLE["q52f_generator_hook"] = """
SELECT item_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS generated FROM benchmark"""
ORACLE["q43_export_csv"] = ORACLE["q41_export"]
ORACLE["q44_run_table"] = RUNS + """
SELECT user_id AS run_id, digest, config_id, last_event = 'purchase' AS finished FROM rd"""

PADDED = pad("cut", 64, "2")
ORACLE["q41b_preference_side"] = f"""
WITH cp AS ({SQL_CONVERSATION_PAIRS}),
pref AS (SELECT a.pos, concat_ws(' ', a.key, b.response) AS txt
         FROM cp a JOIN cp b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2),
{CONV_VOCAB},
{encode_cte('enc', 'pref', 'pos', 'txt')},
f AS (SELECT list_concat([1], ids)[1:64] AS cut FROM enc)
SELECT {ints(PADDED)} AS input_ids, {ints(PADDED)} AS labels,
       {ints(f"list_concat({ones('cut')}, list_transform(range(64 - len(cut)), lambda z: 0))")} AS attention_mask
FROM f"""
