"""DuckDB SQL for the catalogue's queries, written independently of their plans."""

from __future__ import annotations

from ..fixed import DOMAINS, EPSILON, GROUPS, ITEM_CHUNK, MAX_INPUT_TOKENS, MAX_NEW_TOKENS, MAX_SEQS, QUESTION_FOOTER, QUESTION_HEADER, RARE_ZIPF, STYLE_OF_DOMAIN, TEMPLATES, TOKEN_BUDGET, VARIANTS
from ..functions.text import NOT_SPACE, SPACE
from ..operators.features import OTHER_SHAPE, REFERENCE_WORDS, SHAPES, TAGS
from .catalogue import ANSWER_CASES, AUROC_CASES, FILE_CASES, SAMPLE

_q = lambda s: "'" + s.replace("'", "''") + "'"
_nl = lambda s: " || chr(10) || ".join(_q(x) for x in s.split("\n"))

ITEMS = f"""raw AS (
  SELECT doc_id // 5 AS item_no,
    max(CASE WHEN doc_id % 5 = 0 THEN text END) AS question,
    list_filter([max(CASE WHEN doc_id % 5 = 1 THEN text END), max(CASE WHEN doc_id % 5 = 2 THEN text END),
                 max(CASE WHEN doc_id % 5 = 3 THEN text END), max(CASE WHEN doc_id % 5 = 4 THEN text END)], lambda x: x IS NOT NULL) AS options
  FROM documents GROUP BY 1),
items AS (
  SELECT *, md5(coalesce(question, '')) AS item_id, [{", ".join(map(_q, DOMAINS))}][item_no % 3 + 1] AS domain,
    chr((65 + (item_no * 7 + 3) % 5)::INT) AS answer FROM raw),
split AS (
  SELECT *, ('0x' || substr(md5(item_id), 1, 8))::BIGINT AS stable_hash, ('0x' || substr(md5(item_id), 1, 8))::BIGINT % 1000 AS bucket FROM items)"""


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _has(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{NOT_SPACE}'), false)"


def _place(answer: str, options: str) -> str:
    return f"CASE WHEN len({options}) > 0 AND {answer} <> '' AND {_strip(answer)} <> '' AND ascii(upper({_strip(answer)})) - 65 BETWEEN 0 AND len({options}) - 1 THEN ascii(upper({_strip(answer)})) - 65 END"


#: Items with the right option and the others.
GOLD = f"""{ITEMS},
placed AS (SELECT *, {_place("answer", "options")} AS gold_at FROM split),
gold AS (
  SELECT *, options[gold_at + 1] AS gold,
    CASE WHEN gold_at IS NOT NULL THEN list_filter(options, lambda o, i: i <> gold_at + 1) END AS distractors,
    CASE WHEN gold_at IS NOT NULL THEN list_filter(list_filter(options, lambda o, i: i <> gold_at + 1), lambda o: {_has("o")}) END AS usable
  FROM placed)"""


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '.'), lambda s: {_strip('s')}), lambda s: s <> '')"


_LEN = "SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT / count(*) AS mean, (count(*) * sum(length(x) * length(x))::BIGINT - sum(length(x))::BIGINT * sum(length(x))::BIGINT) / (count(*) * count(*)) AS var FROM (SELECT doc_id, unnest({list}) AS x FROM documents) GROUP BY doc_id"
_WORD_LEN, _SENT_LEN = _LEN.format(list=_words("text")), _LEN.format(list=_sentences("text"))
_BURST = "CASE WHEN n IS NULL OR n < 2 OR mean = 0 THEN 0.0::DOUBLE ELSE (floor((var / mean) * 1e6 + 0.5) / 1e6) END"
_ENTROPY = "SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ALL) GROUP BY doc_id"

_COUNTS = "SELECT lower(x) AS token, count(*) AS n FROM (SELECT unnest({words}) AS x FROM {table}) GROUP BY 1"
_ZIPF = "SELECT token, n, log10(n / (SELECT sum(n)::DOUBLE FROM {c})) + 9 AS zipf FROM {c}"

LEXICON = f"""counts AS ({_COUNTS.format(words=_words("text"), table="documents")}),
common AS (SELECT token FROM ({_ZIPF.format(c="counts")}) WHERE zipf >= {RARE_ZIPF})"""
_RARE = f"SELECT doc_id, 1 - count(c.token) / count(*)::DOUBLE AS rate FROM (SELECT doc_id, lower(unnest({_words('text')})) AS token FROM documents) t LEFT JOIN common c USING (token) GROUP BY doc_id"

_TAG = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{t}'" for t, p in SHAPES) + f" ELSE '{OTHER_SHAPE}' END"
SHARES = f"""ref AS (SELECT tag, count(*) / sum(count(*)) OVER () AS q FROM (SELECT {_TAG} AS tag FROM (SELECT unnest({_words("text")}) AS x FROM benchmark)) GROUP BY tag),
tagged AS (SELECT doc_id, tag, count(*) AS c FROM (SELECT doc_id, {_TAG} AS tag FROM (SELECT doc_id, unnest({_words("text")}) AS x FROM documents)) GROUP BY ALL),
totals AS (SELECT doc_id, sum(c) AS n FROM tagged GROUP BY doc_id),
tags AS (SELECT unnest([{", ".join(map(_q, TAGS))}]) AS tag)"""
_KL = f"""SELECT doc_id, sum(p * ln((p + {EPSILON}) / (qq + {EPSILON}))) AS kl FROM (
  SELECT t.doc_id, coalesce(c / n::DOUBLE, {EPSILON}) AS p, coalesce(q, {EPSILON}) AS qq
  FROM totals t CROSS JOIN tags LEFT JOIN tagged g ON g.doc_id = t.doc_id AND g.tag = tags.tag LEFT JOIN ref ON ref.tag = tags.tag
  WHERE c IS NOT NULL OR q IS NOT NULL) GROUP BY doc_id"""
_NAN = "'nan'::DOUBLE"
FEATURE_CTES = f"{LEXICON}, {SHARES}, wl AS ({_WORD_LEN}), sl AS ({_SENT_LEN}), ent AS ({_ENTROPY}), rare AS ({_RARE}), kl AS ({_KL})"
_FEATURES = f"""SELECT d.doc_id, d.lang AS domain, l.quality::BIGINT AS label, coalesce((floor((rate) * 1e6 + 0.5) / 1e6), {_NAN}) AS rare_token_rate,
  {_BURST.replace("n IS NULL OR n ", "wl.n IS NULL OR wl.n ").replace("mean", "wl.mean").replace("var ", "wl.var ")} AS word_len_burstiness,
  {_BURST.replace("n IS NULL OR n ", "sl.n IS NULL OR sl.n ").replace("mean", "sl.mean").replace("var ", "sl.var ")} AS sent_len_burstiness,
  coalesce((floor((e) * 1e6 + 0.5) / 1e6), {_NAN}) AS char_entropy, coalesce((floor((kl) * 1e6 + 0.5) / 1e6), {_NAN}) AS pos_kl_div
FROM documents d JOIN labels l USING (doc_id) LEFT JOIN wl USING (doc_id) LEFT JOIN sl USING (doc_id) LEFT JOIN ent USING (doc_id) LEFT JOIN rare USING (doc_id) LEFT JOIN kl USING (doc_id)"""

# The same for exploded options, which stand in for documents under a row number.
_EXPLODED = f"""e AS (SELECT item_no, item_id, domain, gold_at, unnest(range(len(options))) AS k, options FROM gold WHERE gold_at IS NOT NULL),
rows_ AS (SELECT row_number() OVER () AS doc_id, item_no, item_id, domain, (CASE WHEN k = gold_at THEN 0 WHEN k < gold_at THEN k + 1 ELSE k END)::BIGINT AS option_idx, (k = gold_at)::BIGINT AS label, options[k + 1] AS text FROM e WHERE {_has("options[k + 1]")})"""
_OPTION_CTES = f"{GOLD}, {LEXICON}, {_EXPLODED}, {SHARES}, wl AS ({_WORD_LEN}), sl AS ({_SENT_LEN}), ent AS ({_ENTROPY}), rare AS ({_RARE}), kl AS ({_KL})"
_OPTION_CTES = (_at := _OPTION_CTES.index("ref AS")) and _OPTION_CTES[:_at] + _OPTION_CTES[_at:].replace("FROM documents", "FROM rows_")
_OPTION_FEATURES = _FEATURES.replace("d.doc_id, d.lang AS domain, l.quality::BIGINT AS label", "d.item_no, d.item_id, d.domain, d.option_idx, d.label, md5(d.text) AS text_md5").replace("FROM documents d JOIN labels l USING (doc_id)", "FROM rows_ d")

_letters = "chr((65 + {i})::INT)"


def _order(options: str, variant: str) -> str:
    return f"list_transform(list_sort(list_transform(range(len({options})), lambda i: {{'h': md5(item_id || ':' || {variant} || ':' || i::VARCHAR), 'i': i}})), lambda t: t.i)"


def _prompt(options: str, order: str) -> str:
    lines = f"array_to_string(list_transform({order}, lambda i, k: chr((64 + k)::INT) || '. ' || {options}[i + 1]), chr(10))"
    return f"{_nl(QUESTION_HEADER)} || {lines} || {_nl(QUESTION_FOOTER)}"


_CORRECT = "chr((64 + list_position(ord, 0))::INT)"

PAIRS = f"""{GOLD},
neutral AS (SELECT item_no, item_id, answer, list_transform(options, lambda o: CASE WHEN {_has("o")} THEN lower(o) ELSE o END) AS options FROM split),
nplaced AS (SELECT *, {_place("answer", "options")} AS gold_at FROM neutral QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY item_no DESC) = 1),
ngold AS (SELECT item_id, options[gold_at + 1] AS ng, CASE WHEN gold_at IS NOT NULL THEN list_filter(list_filter(options, lambda o, i: i <> gold_at + 1), lambda o: {_has("o")}) END AS nd FROM nplaced),
pairs AS (SELECT g.item_no, g.item_id, g.domain, g.gold AS rg, g.usable AS rd, ng, nd FROM gold g JOIN ngold USING (item_id)
  WHERE g.bucket < 200 AND g.gold <> '' AND ng <> '' AND len(g.usable) > 0 AND len(nd) > 0),
opts AS (
  SELECT item_no, item_id, domain, 'original' AS variant, list_concat([rg], rd[1:3]) AS o FROM pairs
  UNION ALL SELECT item_no, item_id, domain, 'neutralized', list_concat([ng], nd[1:3]) FROM pairs
  UNION ALL SELECT item_no, item_id, domain, 'adversarial', list_concat([ng, rd[1]], nd[1:2]) FROM pairs),
vars AS (SELECT item_no, item_id, domain, variant, o, {_order("o", "variant")} AS ord FROM opts),
lettered AS (SELECT item_no, item_id, domain, variant, {_CORRECT} AS correct_letter FROM vars)"""

COMPLETIONS = f"""{PAIRS},
said AS (SELECT *, ('0x' || substr(md5(item_id || ':' || variant || ':' || grp), 1, 1))::BIGINT AS d FROM lettered CROSS JOIN (SELECT unnest([{", ".join(map(_q, GROUPS))}]) AS grp)),
completions AS (SELECT *, CASE WHEN d <= 2 THEN '<think>' WHEN d <= 5 THEN 'B' WHEN d <= 8 THEN 'Answer: C' WHEN d <= 10 THEN '0000' ELSE correct_letter END AS completion FROM said)"""
_LETTER = "upper(nullif(regexp_extract({x}, '[A-Ha-h]'), ''))"
ACCURACY = f"""{COMPLETIONS},
scored AS (SELECT *, CASE WHEN {_LETTER.format(x="completion")} = correct_letter THEN 1 ELSE 0 END AS r FROM completions),
acc AS (SELECT grp, variant, domain, count(*) AS n, sum(r)::BIGINT AS n_correct, sum(r) / count(*)::DOUBLE AS accuracy FROM scored GROUP BY GROUPING SETS ((grp, variant), (grp, variant, domain))),
wide AS (SELECT grp, domain, {", ".join(f"coalesce(max(accuracy) FILTER (WHERE variant = '{v}'), {_NAN}) AS {v}" for v in VARIANTS)} FROM acc GROUP BY grp, domain),
gaps AS (SELECT grp, domain, neutralized - adversarial AS gap FROM wide)"""

CHUNKS = f"""{ITEMS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_id, item_no) - 1 AS position FROM items),
chunked AS (SELECT *, position // {ITEM_CHUNK} AS chunk FROM numbered)"""

_STYLE = "CASE domain " + " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in STYLE_OF_DOMAIN.items()) + " ELSE 'prose' END"


def _template(text: str) -> str:
    return f"CASE WHEN {_STYLE} = 'code' THEN replace({_nl(TEMPLATES['code'])}, '{{text}}', {text}) ELSE replace({_nl(TEMPLATES['prose'])}, '{{text}}', {text}) END"


PACKED = f"""RECURSIVE {CHUNKS},
uses AS (SELECT domain, chunk, position, k - 1 AS place, options[k] AS text FROM (SELECT *, unnest(range(1, len(options) + 1)) AS k FROM chunked) WHERE {_has("options[k]")}),
firsts AS (SELECT domain, text, chunk FROM uses QUALIFY row_number() OVER (PARTITION BY domain, text ORDER BY chunk, position, place) = 1),
sized AS (SELECT domain, chunk, md5(text) AS text_md5, least(len({_words("p")}), {MAX_INPUT_TOKENS}) AS length FROM (SELECT *, {_template("text")} AS p FROM firsts)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, chunk ORDER BY length, text_md5) AS k FROM sized),
packed AS (
  SELECT domain, chunk, text_md5, length, k, 0::BIGINT AS batch, 1 AS n FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.domain, r.chunk, r.text_md5, r.length, r.k,
    p.batch + CASE WHEN (p.n + 1) * r.length > {TOKEN_BUDGET} OR p.n + 1 > {MAX_SEQS} THEN 1 ELSE 0 END,
    CASE WHEN (p.n + 1) * r.length > {TOKEN_BUDGET} OR p.n + 1 > {MAX_SEQS} THEN 1 ELSE p.n + 1 END
  FROM packed p JOIN ranked r ON r.domain = p.domain AND r.chunk = p.chunk AND r.k = p.k + 1)"""

_JOINED = "md5(array_to_string({x}, chr(1)))"
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else "'nan'::DOUBLE" if v != v else _q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

_AUROC = f"""SELECT split, feature, CASE WHEN p > 0 AND q > 0 THEN (floor(((ranks - p * (p + 1) / 2) / (p * q)) * 1e6 + 0.5) / 1e6) ELSE {_NAN} END AS auroc, (p + q)::BIGINT AS n_samples FROM (
  SELECT split, feature, sum(label) AS p, sum(1 - label) AS q, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS ranks FROM (
    SELECT split, feature, label, rank() OVER (PARTITION BY split, feature ORDER BY score) + (count(*) OVER (PARTITION BY split, feature, score) - 1) / 2 AS r FROM scores WHERE NOT isnan(score))
  GROUP BY split, feature)"""

SQL: dict[str, str] = {
    "item_identity": f"WITH {ITEMS} SELECT item_no, item_id, domain, stable_hash, bucket, bucket < 200 AS is_test FROM split",
    "split_counts": f"WITH {ITEMS} SELECT domain, bucket < 200 AS is_test, count(*) AS n, count(DISTINCT item_id) AS n_ids FROM split GROUP BY GROUPING SETS ((domain, is_test), (is_test))",
    "answer_index": f"WITH {ITEMS}, cases AS (SELECT item_no::VARCHAR AS case_id, answer, options FROM items UNION ALL SELECT a, b, list_transform(range(c), lambda i: 'x') FROM (VALUES {_values(ANSWER_CASES)}) AS v(a, b, c)) SELECT case_id, len(options) AS n_options, ({_place('answer', 'options')})::BIGINT AS answer_at, ({_place('answer', 'options')}) IS NOT NULL AS valid FROM cases",
    "gold_distractors": f"WITH {GOLD} SELECT item_no, md5(gold) AS gold_md5, {_has('gold')} AS gold_has_text, len(usable) AS n_distractors, {_JOINED.format(x='usable')} AS distractors_md5 FROM gold",
    "options_exploded": f"WITH {GOLD}, e AS (SELECT item_no, item_id, domain, gold_at, unnest(range(len(options))) AS k, options FROM gold WHERE gold_at IS NOT NULL) SELECT item_no, item_id, domain, (CASE WHEN k = gold_at THEN 0 WHEN k < gold_at THEN k + 1 ELSE k END)::BIGINT AS option_idx, (k = gold_at)::BIGINT AS label, options[k + 1] AS text FROM e WHERE {_has('options[k + 1]')}",
    "options_reassembled": f"WITH {ITEMS} SELECT item_no, len(options) AS n_options, {_JOINED.format(x='list_transform(options, lambda o: CASE WHEN ' + _has('o') + ' THEN lower(o) ELSE o END)')} AS options_md5 FROM items",
    "word_sentence_stats": f"SELECT d.doc_id, length(text) AS n_chars, coalesce(w.n, 0) AS n_words, (floor((w.mean) * 1e6 + 0.5) / 1e6) AS words_mean, (floor((w.var) * 1e6 + 0.5) / 1e6) AS words_var, coalesce(s.n, 0) AS n_sents, (floor((s.mean) * 1e6 + 0.5) / 1e6) AS sents_mean, (floor((s.var) * 1e6 + 0.5) / 1e6) AS sents_var FROM documents d LEFT JOIN ({_WORD_LEN}) w USING (doc_id) LEFT JOIN ({_SENT_LEN}) s USING (doc_id)",
    "word_len_burstiness": f"SELECT doc_id, {_BURST} AS word_len_burstiness FROM documents LEFT JOIN ({_WORD_LEN}) USING (doc_id)",
    "sent_len_burstiness": f"SELECT doc_id, {_BURST} AS sent_len_burstiness FROM documents LEFT JOIN ({_SENT_LEN}) USING (doc_id)",
    "char_entropy": f"SELECT doc_id, coalesce((floor((e) * 1e6 + 0.5) / 1e6), {_NAN}) AS char_entropy FROM documents LEFT JOIN ({_ENTROPY}) USING (doc_id)",
    "corpus_zipf": f"WITH counts AS ({_COUNTS.format(words=_words('text'), table='documents')}) SELECT token, n, (floor((zipf) * 1e6 + 0.5) / 1e6) AS zipf FROM ({_ZIPF.format(c='counts')})",
    "rare_token_rate": f"WITH {LEXICON} SELECT doc_id, coalesce((floor((rate) * 1e6 + 0.5) / 1e6), {_NAN}) AS rare_token_rate FROM documents LEFT JOIN ({_RARE}) USING (doc_id)",
    "shape_tag_kl": f"WITH {SHARES} SELECT doc_id, coalesce((floor((kl) * 1e6 + 0.5) / 1e6), {_NAN}) AS pos_kl_div FROM documents LEFT JOIN ({_KL}) USING (doc_id)",
    "feature_table": f"WITH {FEATURE_CTES} {_FEATURES}",
    "option_features": f"WITH {_OPTION_CTES} {_OPTION_FEATURES}",
    "reference_tags": f"WITH w AS (SELECT doc_id, unnest({_words('text')}) AS x, unnest(range(len({_words('text')}))) AS k FROM documents), first AS (SELECT x FROM w QUALIFY row_number() OVER (ORDER BY doc_id, k) <= {REFERENCE_WORDS}) SELECT {_TAG} AS tag, count(*) AS n FROM first GROUP BY 1",
    "linguistic_tokens": "WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’.-][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]') AS w FROM conversations) SELECT conv_id, turn, len(w) AS n_tokens, md5(array_to_string(w, chr(1))) AS tokens_md5 FROM t",
    "text_previews": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents",
    "matched_arms": f"WITH {ITEMS}, drawn AS (SELECT domain, item_no FROM items QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || item_id || ':' || item_no::VARCHAR), item_id, item_no) <= {SAMPLE}) SELECT domain, count(*) AS both, 0::BIGINT AS one FROM drawn GROUP BY domain",
    "training_numbers": "SELECT p AS per_device, s AS steps, p * 4 AS batch, greatest(50, s // 4)::BIGINT AS save_steps FROM range(1, 9) a(p) CROSS JOIN range(1, 601, 57) b(s)",
    "label_balance": f"WITH {GOLD}, e AS (SELECT domain, unnest(range(len(options))) AS k, gold_at, options FROM gold WHERE gold_at IS NOT NULL) SELECT domain, (k = gold_at)::BIGINT AS label, count(*) AS n FROM e WHERE {_has('options[k + 1]')} GROUP BY GROUPING SETS ((domain, label), (label))",
    "keyed_sample": f"WITH {ITEMS} SELECT item_no, item_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || item_id || ':' || item_no::VARCHAR), item_id, item_no) AS draw FROM items QUALIFY draw <= {SAMPLE}",
    "chunk_progress": f"WITH {CHUNKS}, per AS (SELECT domain, chunk, count(*) AS n_items FROM chunked GROUP BY ALL) SELECT domain, chunk, n_items, (sum(n_items) OVER (PARTITION BY domain ORDER BY chunk))::BIGINT AS done, (floor((100.0::DOUBLE * sum(n_items) OVER (PARTITION BY domain ORDER BY chunk) / sum(n_items) OVER (PARTITION BY domain)) * 1e6 + 0.5) / 1e6) AS percent FROM per",
    "option_permutation": f"WITH {GOLD}, t AS (SELECT item_no, item_id, list_concat([gold], usable)[1:4] AS o FROM gold WHERE {_has('gold')} AND len(usable) > 0), p AS (SELECT item_no, {_order('o', _q('train'))} AS ord FROM t) SELECT item_no, array_to_string(ord, ',') AS ord, {_CORRECT} AS correct_letter FROM p",
    "mcq_examples": f"WITH {GOLD}, t AS (SELECT item_no, item_id, list_concat([gold], usable)[1:4] AS o FROM gold WHERE bucket >= 200 AND {_has('gold')} AND len(usable) > 0), p AS (SELECT item_no, item_id, o, {_order('o', _q('train'))} AS ord FROM t) SELECT item_no, item_id, {_prompt('o', 'ord')} AS prompt, {_CORRECT} AS correct_letter FROM p",
    "paired_variants": f"WITH {PAIRS} SELECT item_no, item_id, domain, variant, {_prompt('o', 'ord')} AS prompt, {_CORRECT} AS correct_letter FROM vars",
    "letter_parse": f"SELECT conv_id, turn, {_LETTER.format(x='text')} AS letter FROM conversations",
    "reward": f"SELECT conv_id, turn, CASE WHEN {_LETTER.format(x='text')} = chr((65 + conv_id % 4)::INT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM conversations",
    "reward_sql": f"SELECT conv_id, turn, CASE WHEN {_LETTER.format(x='text')} = chr((65 + conv_id % 4)::INT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM conversations",
    "console_metrics": f"WITH {ACCURACY}, e AS (SELECT domain, unnest(range(len(options))) AS k, gold_at, options FROM gold WHERE gold_at IS NOT NULL) SELECT CASE WHEN bucket < 200 THEN 'test items' ELSE 'training items' END AS name, count(*)::DOUBLE AS value FROM split GROUP BY 1 UNION ALL SELECT 'label ' || (k = gold_at)::INT || ' ' || domain, count(*)::DOUBLE FROM e WHERE {_has('options[k + 1]')} GROUP BY 1 UNION ALL SELECT 'accuracy ' || grp || ' ' || variant || ' ' || coalesce(domain, 'overall'), (floor((accuracy) * 1e6 + 0.5) / 1e6) FROM acc",
    "empty_domains": f"WITH {ITEMS} SELECT d AS domain FROM (SELECT unnest(['math', 'code', 'stem', 'law']) AS d) WHERE d NOT IN (SELECT domain FROM items)",
    "prompt_previews": f"WITH {PAIRS} SELECT item_no, variant, substr({_prompt('o', 'ord')}, 1, 300) AS preview FROM vars",
    "accuracy_by_variant": f"WITH {ACCURACY} SELECT grp, variant, domain, n, n_correct, (floor((accuracy) * 1e6 + 0.5) / 1e6) AS accuracy FROM acc",
    "exploitation_gap": f"WITH {ACCURACY} SELECT grp, domain, (floor((gap) * 1e6 + 0.5) / 1e6) AS gap FROM gaps",
    "verdicts_by_threshold": f"WITH {ACCURACY}, sides AS (SELECT coalesce(domain, 'overall') AS name, (floor((max(gap) FILTER (WHERE grp = 'treatment')) * 1e6 + 0.5) / 1e6) - (floor((max(gap) FILTER (WHERE grp = 'control')) * 1e6 + 0.5) / 1e6) AS diff FROM gaps GROUP BY 1) SELECT a AS name, CASE WHEN isnan(b) THEN 'none' WHEN b >= 0.75 THEN 'strong' WHEN b >= 0.60 THEN 'moderate' ELSE 'none' END AS verdict FROM (VALUES {_values([(n, v if v is None or v != v else float(v)) for n, v in AUROC_CASES])}) AS v(a, b) UNION ALL SELECT 'gap ' || name, CASE WHEN isnan(diff) THEN 'none' WHEN diff > 0.05 THEN 'confirmed' WHEN diff > 0 THEN 'weak' ELSE 'none' END FROM sides",
    "auroc_rank": f"WITH {FEATURE_CTES}, f AS ({_FEATURES}), both_ AS (SELECT 'overall' AS split, * FROM f UNION ALL SELECT domain, * FROM f), scores AS (UNPIVOT (SELECT split, label, rare_token_rate, word_len_burstiness, sent_len_burstiness, char_entropy, pos_kl_div FROM both_) ON rare_token_rate, word_len_burstiness, sent_len_burstiness, char_entropy, pos_kl_div INTO NAME feature VALUE score) {_AUROC}",
    "report_table": f"WITH {ACCURACY} SELECT grp, domain, (floor((original) * 1e6 + 0.5) / 1e6) AS original, (floor((neutralized) * 1e6 + 0.5) / 1e6) AS neutralized, (floor((adversarial) * 1e6 + 0.5) / 1e6) AS adversarial, (floor((neutralized - adversarial) * 1e6 + 0.5) / 1e6) AS gap FROM wide",
    "chart_gap": f"WITH {ACCURACY} SELECT t.domain, (floor((t.gap) * 1e6 + 0.5) / 1e6) AS treatment, coalesce((floor((c.gap) * 1e6 + 0.5) / 1e6), 0) AS control FROM gaps t LEFT JOIN gaps c ON c.domain IS NOT DISTINCT FROM t.domain AND c.grp = 'control' WHERE t.grp = 'treatment'",
    "report_text": f"WITH {ACCURACY} SELECT string_agg(grp || '|' || coalesce(domain, 'overall') || '|' || variant || '|' || n_correct || '|' || n, chr(10) ORDER BY grp, coalesce(domain, ''), variant) AS report FROM acc",
    "dedup_fanout": f"WITH {ITEMS}, e AS (SELECT item_no, domain, unnest(range(len(options))) AS place, options FROM items) SELECT item_no, place, domain, md5(lower(options[place + 1])) AS new_md5 FROM e WHERE {_has('options[place + 1]')}",
    "resume_pending": f"WITH {ITEMS} SELECT item_no, item_id, domain FROM items WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_no % 2 = 0)",
    "greedy_packing": f"WITH {PACKED} SELECT domain, chunk, batch, text_md5, length FROM packed",
    "decode_budget": f"WITH {PACKED} SELECT domain, chunk, batch, count(*) AS n_seqs, max(length) AS longest, least({MAX_NEW_TOKENS}, ceil(max(length) * 1.6::DOUBLE)::BIGINT + 32) AS budget FROM packed GROUP BY domain, chunk, batch",
    "control_rows": f"WITH {ITEMS}, n AS (SELECT item_no, item_id, domain, question, answer, list_transform(options, lambda o: CASE WHEN {_has('o')} THEN lower(o) ELSE o END) AS options FROM items) SELECT item_no, item_id, domain, {_STYLE} AS style, md5(question) AS question_md5, {_JOINED.format(x='options')} AS options_md5, md5({_template('options[1]')}) AS prompt_md5, answer FROM n WHERE len(options) > 0 AND answer <> ''",
    "chat_prompts": f"WITH {ITEMS}, e AS (SELECT item_no, domain, unnest(range(len(options))) AS place, options FROM items), u AS (SELECT item_no, domain, place, options[place + 1] AS text FROM e WHERE {_has('options[place + 1]')}) SELECT item_no, place, md5('<|im_start|>user' || chr(10) || ({_template('text')}) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS chat_md5, md5(CASE WHEN len({_words('text')}) > 64 THEN array_to_string({_words('text')}[1:64], ' ') ELSE text END) AS cut_md5, least(len({_words('text')}), 64)::BIGINT AS length FROM u",
    "completion_profile": f"WITH p AS (SELECT role, count(*) AS n, count(*) FILTER (WHERE NOT {_has('text')}) AS empty_or_whitespace, count(*) FILTER (WHERE {_LETTER.format(x='text')} IS NOT NULL) AS contains_valid_letter FROM conversations GROUP BY role), f AS (SELECT role, substr(text, 1, 1) AS first_char, count(*) AS n_first FROM conversations WHERE length(text) > 0 GROUP BY ALL) SELECT role, n, empty_or_whitespace, contains_valid_letter, first_char, n_first FROM p LEFT JOIN f USING (role)",
    "policy_agreement": f"WITH {COMPLETIONS}, s AS (SELECT item_no, item_id, variant, max(completion) FILTER (WHERE grp = 'treatment') AS t, max(completion) FILTER (WHERE grp = 'control') AS c FROM completions GROUP BY ALL) SELECT variant, count(*) FILTER (WHERE t IS NOT DISTINCT FROM c) AS same, count(*) AS n, (count(*) FILTER (WHERE t IS NOT DISTINCT FROM c)) || '/' || count(*) AS identical_outputs FROM s GROUP BY variant",
    "file_overlap": f"WITH f AS (SELECT * FROM (VALUES {_values(FILE_CASES)}) AS v(grp, file, md5)) SELECT file, md5 FROM f WHERE grp = 'treatment' INTERSECT SELECT file, md5 FROM f WHERE grp = 'control'",
    "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k, json_object('k', (props->>'$.k')::BIGINT, 'event_type', event_type)::VARCHAR AS out FROM events",
}
