"""DuckDB SQL for the queries: common table expressions, put together by what each one names."""

from __future__ import annotations

import re

from ..functions.names import MATCH_STOP_WORDS, STOP_WORDS

def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP, _MATCH_STOP = _listed(STOP_WORDS), _listed(MATCH_STOP_WORDS)


def _hash(parts: str) -> str:
    return f"cast(concat('0x', substr(md5(concat_ws('|', {parts})), 1, 13)) as bigint)"


def _unit(parts: str) -> str:
    return f"({_hash(parts)} / 4503599627370496.0)"


def _abbr(w: str) -> str:
    return f"upper(substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '[aeiou]', '', 'g'))"


def _tokens(name: str) -> str:
    """Tokens of an ASCII name of letters, digits and single symbols within."""
    parted = rf"regexp_replace(regexp_replace({name}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')"
    return rf"list_transform(regexp_extract_all({parted}, '[A-Za-z]+|[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\1'))"


def _words(text: str, rx: str = "[a-z]+") -> str:
    return f"regexp_extract_all({text}, '{rx}')"


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substr('##' || {x} || '$$', i, 3)))"


def _segments(table: str, key: str) -> str:
    return f"""
select seg_id, array_to_string(list_transform(w, lambda x: {_abbr("x")}), '_') as name, array_to_string(w, ' ') as term
from (select {_hash(f"{key}, i")} as seg_id, ws[6 * i + 1:6 * i + 6] as w
      from (select {key}, ws, unnest(range(0, cast(ceil(len(ws) / 6.0) as bigint))) as i
            from (select {key}, {_words("lower(text)")} as ws from {table})))"""


#: name -> SELECT; a query may name any of them.
CTES: dict[str, str] = {
    "gold": f"""
select {_abbr("w[1]")} || '_' || {_abbr("w[2]")} || '_' || upper(substr(w[3], 1, 3)) as name, term
from (select distinct p_name || ' ' || lower(p_type) as term, string_split(p_name || ' ' || lower(p_type), ' ') as w from part)""",
    "names": f"select distinct {_hash('name')} as name_id, name, {_tokens('name')} as tokens from gold",
    "terms": f"select {_hash('term')} as term_id, term, {_tokens('term')} as tokens from gold",
    "large": _segments("documents", "doc_id"),
    "large_terms": f"""
select {_hash("doc_id, i")} as seg_id, array_to_string(ws[6 * i + 1:6 * i + 6], ' ') as term
from (select doc_id, ws, unnest(range(0, cast(ceil(len(ws) / 6.0) as bigint))) as i
      from (select doc_id, {_words("lower(text)")} as ws from documents))""",
    "asked": _segments("benchmark", "item_id"),
    "large_names": "select distinct name, string_split(name, '_') as tokens from large",
    "large_index": f"""
select distinct token, term from (select term, unnest(string_split(term, ' ')) as token from (select distinct term from large_terms))
where token not in ({_STOP})""",
    "cells": "select 't' || term as cell_id, term as text from gold union all select 'b' || item_id, text from benchmark",
    "lexicon": f"select distinct unnest({_words('lower(text)')}) as form from cells",
    "domain": "select distinct word from (select lower(unnest(string_split_regex(text, '[/. ,&()_-]'))) as word from cells) where word <> ''",
    "tokens": "select name_id, name, unnest(range(0, len(tokens))) as pos, unnest(tokens) as token from names",
    "classified": f"""
select name_id, name, pos, token,
  lower(token) in (select form from lexicon)
  and (length(token) > 3 or lower(token) in (select word from domain) or lower(token) in ({_STOP})) as english
from tokens""",
    "vocabulary": "select distinct lower(token) as token from classified where not english and regexp_matches(token, '^[A-Za-z]')",
    "longest": "select max(least(length(token) + 5, 2 * length(token))) as n from vocabulary where regexp_matches(token, '^[a-z]+$')",
    "segments": r"""
select list_filter(string_split(lower(s), ' '), lambda x: x <> '') as w
from (select unnest(string_split_regex(text, '[.,;:()=*&]')) as s from cells)""",
    "phrases": f"""
select distinct array_to_string(w[i:i + n - 1], ' ') as phrase
from (select w, i, unnest(range(1, least(len(w) - i + 1, (select n from longest)) + 1)) as n
      from (select w, unnest(range(1, len(w) + 1)) as i from segments)
      where w[i] not in ({_STOP}) and substr(w[i], 1, 1) in (select substr(token, 1, 1) from vocabulary))
where w[i + n - 1] not in ({_STOP})""",
    "single": """
select token, word as expansion from vocabulary join domain on substr(token, 1, 1) = substr(word, 1, 1)
where length(token) < length(word) and word like '%' || array_to_string(string_split(token, ''), '%') || '%'""",
    "acronyms": f"""
with recursive walk(token, phrase, w, i, k) as (
  select token, phrase, string_split(phrase, ' '), 1, 0 from vocabulary join phrases
    on substr(token, 1, 1) = substr(phrase, 1, 1) where length(token) < length(phrase)
  union all
  select token, phrase, w, i + 1, case when substr(w[i], 1, 1) = substr(token, k + 1, 1) then k + 1 else k end
  from walk where i <= len(w) and k < length(token)
    and (substr(w[i], 1, 1) = substr(token, k + 1, 1) or w[i] in ({_STOP})))
select distinct token, phrase as expansion from walk where i = len(w) + 1 and k = length(token)""",
    "expansions": "select * from single union all select * from acronyms",
    "cell_words": f"""
select cell_id, lower(text) as raw,
  list_filter(string_split_regex(lower(text), '[;:''/. ,&()_-]'), lambda x: length(x) > 1 and x not in ({_STOP})) as w
from cells""",
    "runs": f"""
select expansion, run, case when contains(expansion, ' ') then len(run) + 3 else 3 end as reach
from (select distinct expansion,
        list_filter(string_split_regex(expansion, '[ -]'), lambda x: length(x) > 1 and x not in ({_STOP})) as run from expansions)
where len(run) > 0""",
    "cell_places": "select cell_id, raw, w, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from cell_words",
    "hits": """
select cell_id, w, i - 1 as p, expansion, reach,
  row_number() over (partition by cell_id, expansion order by i) as k
from cell_places join runs on word = run[1] where w[i:i + len(run) - 1] = run and contains(raw, expansion)""",
    "contexts": """
with recursive scan(cell_id, expansion, k, start, a, b) as (
  select distinct cell_id, expansion, cast(0 as bigint), cast(0 as bigint), cast(-1 as bigint), cast(-1 as bigint) from hits
  union all
  select h.cell_id, h.expansion, h.k, case when p >= start then least(p + reach, len(w)) else start end,
    case when p >= start then greatest(p - 3, start) else -1 end, case when p >= start then least(p + reach, len(w)) else -1 end
  from scan s join hits h on h.cell_id = s.cell_id and h.expansion = s.expansion and h.k = s.k + 1)
select s.expansion, s.cell_id, w[a + 1:b] as win from scan s join cell_words c on c.cell_id = s.cell_id where a >= 0""",
    "vectors": f"""
select form as word, cast(embedding as double[]) as v
from (select form, {_hash("form")} % (select count(*) from embeddings) as vec_id from lexicon) join embeddings using (vec_id)""",
    "dims": "select word, unnest(range(0, len(v))) as dim, unnest(v) as x from vectors",
    "name_vector": """
select name_id, dim, avg(x) as x from tokens join dims on lower(token) = word
where regexp_matches(token, '^[A-Za-z]') and length(token) > 1 group by all""",
    "context_counts": "select expansion, word, count(*) as n from (select expansion, unnest(win) as word from contexts) group by all",
    "expansion_vector": """
select expansion, dim, sum(n / total * x) as x
from context_counts join (select expansion, sum(n) as total from context_counts group by 1) using (expansion)
join dims using (word) where length(word) > 1 group by all""",
    "cosines": """
select name_id, expansion, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) as c
from name_vector a join expansion_vector b using (dim) group by all""",
    "usable": """
select token, expansion from expansions where expansion in (select expansion from expansion_vector)
and (not contains(expansion, ' ') or len(list_filter(string_split(expansion, ' '), lambda x: x not in (select word from vectors))) = 0)""",
    "unknown_phrases": """
select distinct expansion from (select expansion, unnest(string_split(expansion, ' ')) as word from expansions where contains(expansion, ' '))
where word not in (select word from vectors)""",
    "ranked": """
select * from (
  select name_id, pos, expansion, score, row_number() over (partition by name_id, pos order by round(score, 9) desc, expansion) as rank
  from (
    select c.name_id, pos, expansion, coalesce(c2.c, 0.0) as score
    from classified c join expansions e on lower(c.token) = e.token left join cosines c2 using (name_id, expansion)
    where not english and regexp_matches(c.token, '^[A-Za-z]') and expansion in (select expansion from expansion_vector)
      and expansion not in (select expansion from unknown_phrases)
    union all
    select name_id, pos, token, 0.0 from classified where not english and not regexp_matches(token, '^[A-Za-z]')))
where rank <= 3""",
    "combined": """
select name_id, pos, lower(token) as expansion, 0.99 as score, 1 as rank from classified where english
union all select name_id, pos, expansion, score, rank from ranked
union all select name_id, pos, lower(token), -1.0, 1 from classified anti join ranked using (name_id, pos) where not english""",
    "products": """
select a.name_id, a.expansion || ' ' || b.expansion || ' ' || c.expansion as text,
  case when a.n and b.n and c.n then 0.0 else
    (case when a.n then 1.0 else a.score end) * (case when b.n then 1.0 else b.score end) * (case when c.n then 1.0 else c.score end) end as score,
  a.rank as r1, b.rank as r2, c.rank as r3
from (select *, score in (-1.0, 0.0) as n from combined where pos = 0) a
join (select *, score in (-1.0, 0.0) as n from combined where pos = 1) b using (name_id)
join (select *, score in (-1.0, 0.0) as n from combined where pos = 2) c using (name_id)""",
    "derived": """
select name_id, i - 1 as i, text, score from (
  select *, row_number() over (partition by name_id order by round(-score, 9), r1, r2, r3) as i from products) where i <= 10""",
    "term_index": f"""
select distinct token, term from (select term, lower(unnest(tokens)) as token from terms)
where regexp_matches(token, '^[a-z]') and token not in ({_STOP})""",
    "candidates": """
select name_id, name, term_id, term from (
  select distinct name_id, name, term
  from (select distinct name_id, unnest(string_split(text, ' ')) as token from derived)
  join names using (name_id) join term_index using (token)
  where token in (select token from term_index group by 1 having count(*) < 300)) join terms using (term)""",
    "labelled": "select c.*, g.term is not null as label from candidates c left join gold g on c.name = g.name and c.term = g.term",
    "pair_texts": f"""
select l.name_id, l.name, l.term_id, l.term, label, {_grams("d.text")} as a, {_grams("l.term")} as b
from labelled l join derived d using (name_id)""",
    "grams": """
select name_id, name, term_id, term, label,
  round(max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))), 6) as p
from pair_texts group by all""",
    "gold_seeds": f"""
select name_id, term_id, label from (
  select *, row_number() over (partition by label order by {_unit("'gold', name_id, term_id")}, name_id, term_id) as r from grams) where r <= 5""",
    "matches": "select name_id, name, term_id, term, p > 0.5 as match from grams",
    "judged": """
select coalesce(m.name, g.name) as name, coalesce(m.term, g.term) as term, m.name is not null as found, g.name is not null as is_gold
from (select distinct name, term from matches where match) m full join gold g on m.name = g.name and m.term = g.term""",
    "quality": """
select *, 2 * precision * recall / nullif(precision + recall, 0) as f1 from (
  select tp, fp, fn, tp * 100.0 / nullif(tp + fp, 0) as precision, tp * 100.0 / nullif(tp + fn, 0) as recall from (
    select count(*) filter (found and is_gold) as tp, count(*) filter (found and not is_gold) as fp,
           count(*) filter (is_gold and not found) as fn from judged))""",
    "uses": f"""
select name, lower(unnest({_tokens("name")})) as token, unnest(string_split(term, ' ')) as phrase from gold""",
    "rules": """
select token, phrase as expansion, score, cast(row_number() over (partition by token order by score desc, phrase) as integer) as rank
from (select token, phrase, n / sum(n) over (partition by token) as score
      from (select token, phrase, count(*) as n from uses group by all))""",
    "more_vocabulary": r"""
select token from vocabulary union
select substr(w[1], 1, 1) || substr(w[2], 1, 1) || substr(w[3], 1, 1) from (
  select list_filter(string_split(unnest(string_split_regex(lower(text), '[^a-z ]+')), ' '), lambda x: x <> '') as w from benchmark)
where len(w) >= 3""",
    "more_longest": "select max(least(length(token) + 5, 2 * length(token))) as n from more_vocabulary where regexp_matches(token, '^[a-z]+$')",
    "more_phrases": f"""
select distinct array_to_string(w[i:i + n - 1], ' ') as phrase
from (select w, i, unnest(range(1, least(len(w) - i + 1, (select n from more_longest)) + 1)) as n
      from (select w, unnest(range(1, len(w) + 1)) as i from segments)
      where w[i] not in ({_STOP}) and substr(w[i], 1, 1) in (select substr(token, 1, 1) from more_vocabulary))
where w[i + n - 1] not in ({_STOP})""",
    "more_acronyms": f"""
with recursive walk(token, phrase, w, i, k) as (
  select token, phrase, string_split(phrase, ' '), 1, 0 from more_vocabulary join more_phrases
    on substr(token, 1, 1) = substr(phrase, 1, 1) where length(token) < length(phrase)
  union all
  select token, phrase, w, i + 1, case when substr(w[i], 1, 1) = substr(token, k + 1, 1) then k + 1 else k end
  from walk where i <= len(w) and k < length(token)
    and (substr(w[i], 1, 1) = substr(token, k + 1, 1) or w[i] in ({_STOP})))
select distinct token, phrase as expansion from walk where i = len(w) + 1 and k = length(token)""",
    "restricted": """
with recursive walk(token, expansion, i, j) as (
  select token, expansion, 0, 1 from single
  union all
  select token, expansion, case when i < length(token) and substr(token, i + 1, 1) = substr(expansion, j, 1)
    and not (substr(token, i + 1, 1) in ('a', 'e', 'i', 'o', 'u') and i > 0 and j > 1 and substr(token, i, 1) <> substr(expansion, j - 1, 1))
    then i + 1 else i end, j + 1
  from walk where j <= length(expansion))
select token, expansion from walk where j = length(expansion) + 1 and i = length(token)""",
    "ruled": """
select name_id, pos, expansion, score, r.rank from (select name_id, pos, lower(token) as token from classified) join rules r using (token) where r.rank <= 3""",
    "revised_combined": "select * from combined anti join ruled using (name_id, pos) union all select * from ruled",
    "asked_pairs": f"""
select distinct name_id, name, own, term from (select seg_id as name_id, name, term as own, unnest(string_split(term, ' ')) as token from asked)
join all_index using (token) where token in (select token from all_index group by 1 having count(*) < 300)""",
    "all_terms": "select term from large_terms union select term from asked",
    "all_index": f"select * from (select distinct unnest(string_split(term, ' ')) as token, term from all_terms) where token not in ({_STOP})",
    "asked_sets": f"select name_id, name, term, {_grams('own')} as a, {_grams('term')} as b from asked_pairs",
    "asked_grams": """
select name_id, name, term, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) as p from asked_sets""",
    "asked_labelled": f"""
select a.name_id, a.name, {_hash("a.term")} as term_id, a.term, p, g.term is not null as label
from asked_grams a left join (select distinct name, term from asked) g on a.name = g.name and a.term = g.term""",
    "doc_words": "select distinct word from (select lower(unnest(string_split_regex(text, '[/. ,&()_-]'))) as word from documents) where word <> ''",
    "doc_tokens": f"""
select name, pos, token, lower(token) in (select form from bench_words)
  and (length(token) > 3 or lower(token) in (select word from doc_words) or lower(token) in ({_STOP})) as english
from (select name, unnest(range(0, len(tokens))) as pos, unnest(tokens) as token from large_names)""",
    "bench_words": f"select distinct unnest({_words('lower(text)')}) as form from benchmark",
    "doc_vocabulary": "select distinct lower(token) as token from doc_tokens where not english",
    "asked_judged": """
select m.name is not null as found, g.name is not null as is_gold
from (select distinct name, term from asked_grams where p > 0.5) m full join (select distinct name, term from asked) g on m.name = g.name and m.term = g.term""",
    "large_uses": """
select distinct name, term, lower(unnest(string_split(name, '_'))) as token, unnest(string_split(term, ' ')) as phrase, unnest(range(len(string_split(name, '_')))) as i from large""",
    "dictionary": "select distinct name, token, phrase as expansion from uses",
    "own": f"select * from dictionary where {_unit(chr(39) + 'own' + chr(39) + ', name')} < 1 / 3.0",
    "slots": "select distinct name, pos, lower(token) as token from classified join ranked using (name_id, pos) where not english",
    "entries": """
select s.*, expansion, 0.4 as boost from slots s join own using (name, token)
union all
select s.*, expansion, 0.3 from slots s join (select distinct token, expansion from dictionary) using (token)
where s.name not in (select name from own)""",
    "choices": """
select *, row_number() over (partition by name_id, pos order by expansion) as r from (
  select distinct t.name_id, t.name, pos, coalesce(o.expansion, d.expansion, lower(t.token)) as expansion
  from tokens t left join own o on o.name = t.name and o.token = lower(t.token)
  left join (select distinct token, expansion from dictionary) d on d.token = lower(t.token) and o.token is null)""",
    "made_strings": """
select name_id, text, min(k) as k from (
  select a.name_id, a.expansion || ' ' || b.expansion || ' ' || c.expansion as text,
    row_number() over (partition by a.name_id order by a.r, b.r, c.r) as k
  from (select * from choices where pos = 0) a join (select * from choices where pos = 1) b using (name_id)
  join (select * from choices where pos = 2) c using (name_id)) group by all""",
    "tops": """
select n.name_id, n.name in (select name from own) as has,
  case when n.name in (select name from own) then 1.0 else coalesce(max(score), 0.5) end as top
from names n left join derived d using (name_id) group by n.name_id, n.name""",
    "kept_strings": """
select name_id, text, max(score) as score, min(i) as i from derived join tops using (name_id)
where not has or score = 1.0 group by all""",
    "run_pairs": """
select m.name_id, m.name, m.term_id, m.term, g.p, m.match as said, s.label, coalesce(s.label, m.match) as match
from matches m join grams g on m.name_id = g.name_id and m.term_id = g.term_id
left join gold_seeds s on m.name_id = s.name_id and m.term_id = s.term_id""",
    "run_judged": """
select coalesce(m.name, g.name) as name, coalesce(m.term, g.term) as term, match,
  case when match and g.name is not null then 'TP' when match then 'FP' when g.name is not null then 'FN' else 'TN' end as score_eval
from run_pairs m full join gold g on m.name = g.name and m.term = g.term""",
    "boosted": """
select name, pos, expansion, coalesce(r.score, 0.0) + coalesce(e.boost, 0.0) as score
from (select name, pos, lower(token) as token, expansion, score from ranked join classified using (name_id, pos)) r
full join entries e using (name, pos, token, expansion)""",
}

CTES["revised_products"] = CTES["products"].replace("from combined", "from revised_combined")
CTES["revised"] = CTES["derived"].replace("from products", "from revised_products")

#: query -> SELECT over the expressions above and the driver's tables.
BODIES: dict[str, str] = {
    "scan_gold": "select distinct p_brand as name, p_name || ' ' || p_type as term from part where p_size > 3",
    "scan_names": f"select {_hash('name')} as name_id, name, array_to_string(tokens, ' ') as tokens from large_names",
    "scan_terms": "select seg_id as term_id, term, term as tokens from large_terms",
    "format_relation_text": """
select prefix || '(' || string_agg(c, ', ' order by c) || ')' as value
from (select distinct upper(p_type) || '.' || upper(replace(p_brand, '#', '')) as prefix, upper(replace(p_name, ' ', '_')) as c from part) group by prefix""",
    "scan_relation_text": """
select distinct upper(p_type) as schema_name, upper(replace(p_brand, '#', '')) as table_name, upper(replace(p_name, ' ', '_')) as column_name from part""",
    "scan_term_text": "select distinct term from large_terms",
    "format_term_text": "select distinct p_name || ' ' || p_type as value from part where p_size > 3",
    "scan_relation_file": f"""
select {_hash("schema_name, table_name, column_name")} as col_id, * from (
  select distinct upper(p_type) as schema_name, upper(replace(p_brand, '#', '')) as table_name, upper(replace(p_name, ' ', '_')) as column_name from part)""",
    "scan_term_file": f"select distinct {_hash('term')} as term_id, term from large_terms",
    "load_vector_text": "select word, cast(len(v) as integer) as dims, round(list_sum(list_transform(v, lambda x: x * x)), 6) as norm2 from vectors",
    "expand_restricted": "select token, expansion from restricted",
    "lemma_tokens": f"""
with lex as (select distinct unnest({_words("lower(text)")}) as form from benchmark),
lemma_domain as (select distinct unnest(string_split(term, ' ')) as form from gold),
given as (select distinct replace(term, ' ', '_') as name, string_split(term, ' ') as tokens from large_terms),
each as (select name, unnest(range(0, len(tokens))) as pos, unnest(tokens) as token from given)
select name, cast(pos as integer) as pos, token,
  ((token not like '%s' and token in (select form from lex)) or
   (token like '%s' and length(token) > 2 and token[:-2] not like '%s' and token[:-2] in (select form from lex)))
  and (length(token) > 3 or token in (select form from lemma_domain) or token in ({_STOP})) as english
from each""",
    "gram_documents": "select name_id, term, p from asked_grams",
    "noisy_documents": """
select name, string_agg(case when english then token else '_' end, ' ' order by pos) as english_tokens,
  coalesce(string_agg(token, ' ' order by pos) filter (not english), '') as noisy_tokens from doc_tokens group by name""",
    "expand_documents": """
select token, word as expansion from doc_vocabulary join doc_words on substr(token, 1, 1) = substr(word, 1, 1)
where length(token) < length(word) and contains(word, substr(token, 2, 1)) and contains(word, substr(token, 3, 1)) and contains(word, substr(token, -1))
  and word like '%' || array_to_string(string_split(token, ''), '%') || '%'""",
    "blocking_documents": """
select (select count(*) from asked_pairs) as pairs,
  round((select count(*) from asked_pairs) / ((select count(*) from asked) * cast((select count(*) from all_terms) as double)), 9) as ratio,
  round((select count(*) from (select distinct name, term from asked) semi join asked_pairs using (name, term))
    / cast((select count(*) from (select distinct name, term from asked)) as double), 9) as recall""",
    "label_documents": "select name_id, term, label from asked_labelled",
    "uncertain_documents": f"""
select name_id, term_id, round(entropy, 6) as entropy from (
  select *, case when entropy > 0 then -ln(greatest({_unit("'round', name_id, term_id")}, 1e-16)) / entropy end as key from (
    select name_id, term_id, case when p > 0 and p < 1 then -p * log2(p) - (1 - p) * log2(1 - p) else 0.0 end as entropy from asked_labelled)
  order by round(entropy, 9) desc, name_id, term_id limit 100)
order by key nulls last, name_id, term_id limit 10""",
    "seeds_documents": f"""
select name_id, term_id, false as label from asked_labelled where p < 0.8 order by {_unit("'negative', name_id, term_id")}, name_id, term_id
limit (select count(*) from asked_labelled where p >= 0.8)""",
    "eval_documents": """
select coalesce(m.name, g.name) as name, coalesce(m.term, g.term) as term,
  case when match and g.name is not null then 'TP' when match then 'FP' when g.name is not null then 'FN' else 'TN' end as score_eval
from (select distinct name, term, p > 0.5 as match from asked_grams) m
full join (select distinct name, term from asked) g on m.name = g.name and m.term = g.term""",
    "match_documents": """
select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) as f1 from (
  select tp, fp, fn, tp * 100.0 / nullif(tp + fp, 0) as precision, tp * 100.0 / nullif(tp + fn, 0) as recall from (
    select count(*) filter (found and is_gold) as tp, count(*) filter (found and not is_gold) as fp,
           count(*) filter (is_gold and not found) as fn from asked_judged))""",
    "review_gold_pairs": f"select name, term, p from grams where p >= 0.3 and label order by {_unit(chr(39) + 'review' + chr(39) + ', name, term')}, name, term limit 2",
    "overall_dictionary": "select distinct token, expansion from dictionary",
    "windows_dictionary": "select name, token, expansion from dictionary",
    "rules_documents": """
select token, phrase as expansion, round(score, 6) as score, cast(row_number() over (partition by token order by score desc, phrase) as integer) as rank
from (select token, phrase, n / sum(n) over (partition by token) as score
      from (select token, phrase, count(*) as n from large_uses group by all))""",
    "dictionary_documents": "select distinct token, phrase as expansion from large_uses",
    "revise_rules": """
with was as (select name_id, list(text order by i) as l from derived group by 1),
now as (select name_id, list(text order by i) as l from revised group by 1)
select name_id, was.l <> now.l as updated, cast(i as integer) as i, text, round(score, 6) as score
from revised join was using (name_id) join now using (name_id)""",
    "sink_csv": "select name, cast(to_json(tokens) as varchar) as tokens from names",
    "load_vectors": "select word, cast(len(v) as integer) as dims, round(list_sum(list_transform(v, lambda x: x * x)), 6) as norm2 from vectors",
    "tokenize_names": f"""
with given as (
  select string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2)
         || lpad(cast(p_size as varchar), 4, '0') || upper(substr(p_type, 1, 2)) || string_split(p_name, ' ')[1] as name from part
  union select p_brand || '_' || p_type from part union select name from large)
select name, array_to_string({_tokens("name")}, ' ') as tokens from given""",
    "domain_words": """
select distinct word from (select lower(unnest(string_split_regex(text, '[/. ,&()_-]'))) as word from documents) where word <> ''""",
    "phrase_windows": "select phrase from phrases",
    "context_tokens": f"""
select name, array_to_string(t, ' ') as context,
  array_to_string(case when len(m) >= 2 and length(m[1]) = 1 then m[2:] else m end, ' ') as matching
from (select name, list_transform(tokens, lambda x: lower(x)) as t,
        list_filter(list_transform(tokens, lambda x: lower(x)), lambda x: x not in ({_MATCH_STOP})) as m
      from large_names)""",
    "noisy_tokens": """
select name, string_agg(case when english then token else '_' end, ' ' order by pos) as english_tokens,
  coalesce(string_agg(token, ' ' order by pos) filter (not english), '') as noisy_tokens from classified group by name_id, name""",
    "expand_single_word": "select token, expansion from single",
    "expand_acronym": "select token, expansion from more_acronyms",
    "noisy_token_histogram": "select token, count(*) as n from classified where not english group by 1 order by n desc, token limit 100",
    "candidate_context": "select expansion, cell_id, array_to_string(win, ' ') as window from contexts",
    "name_context_vector": "select name_id, cast(dim as integer) as dim, round(x, 6) as x from name_vector",
    "expansion_vector": "select expansion, cast(dim as integer) as dim, round(x, 6) as x from expansion_vector",
    "rank_expansions": "select name_id, cast(pos as integer) as pos, expansion, round(score, 6) as score, cast(rank as integer) as rank from ranked",
    "combined_candidates": "select name_id, cast(pos as integer) as pos, expansion, round(score, 6) as score, cast(rank as integer) as rank from combined",
    "derived_strings": "select name_id, cast(i as integer) as i, text, round(score, 6) as score from derived",
    "dedup_derived": "select name_id, text, round(max(score), 6) as score from derived group by all",
    "index_token_filter": "select token, term from large_index",
    "df_cap": "select token, count(*) as df from large_index group by 1 having count(*) < 300",
    "inverted_index": "select token, term, count(*) over (partition by token) as df from large_index",
    "block_candidates": "select name_id, name, term_id, term from candidates",
    "block_documents": """
with rare as (select token from large_index group by 1 having count(*) < 300),
words as (select distinct seg_id as name_id, name, unnest(string_split(term, ' ')) as token from asked),
pairs as (select distinct name_id, name, term from words join rare using (token) join large_index using (token))
select name_id, pairs.name, large_terms.seg_id as term_id, term from pairs join large_terms using (term)""",
    "blocking_stats": """
select (select count(*) from candidates) as pairs,
  round((select count(*) from candidates) / ((select count(*) from names) * cast((select count(*) from terms) as double)), 9) as ratio,
  round((select count(*) from gold semi join candidates using (name, term)) / cast((select count(*) from gold) as double), 9) as recall""",
    "label_from_gold": "select name, term, label from labelled",
    "pair_ngrams": "select name, term, p from grams",
    "negative_seeds": f"""
select name_id, term_id, false as label from grams where p < 0.8 order by {_unit("'negative', name_id, term_id")}, name_id, term_id limit (select count(*) from grams where p >= 0.8)""",
    "gold_seeds": "select * from gold_seeds",
    "uncertain_pairs": f"""
select name_id, term_id, round(entropy, 6) as entropy from (
  select *, case when entropy > 0 then -ln(greatest({_unit("'round', name_id, term_id")}, 1e-16)) / entropy end as key from (
    select name_id, term_id, case when p > 0 and p < 1 then -p * log2(p) - (1 - p) * log2(1 - p) else 0.0 end as entropy from grams)
  order by round(entropy, 9) desc, name_id, term_id limit 100)
order by key nulls last, name_id, term_id limit 10""",
    "apply_labels": """
select m.name_id, m.term_id, name_match as match from (
  select m.name_id, m.term_id, coalesce(s.label, m.match) as name_match from matches m left join gold_seeds s on m.name_id = s.name_id and m.term_id = s.term_id) m""",
    "eval_outer": "select name, term, found, is_gold from judged",
    "precision_recall": "select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from quality",
    "match_report": "select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from quality",
    "score_eval": """
select coalesce(m.name, g.name) as name, coalesce(m.term, g.term) as term,
  case when match and g.name is not null then 'TP' when match then 'FP' when g.name is not null then 'FN' else 'TN' end as score_eval
from matches m full join gold g on m.name = g.name and m.term = g.term""",
    "review_pairs": f"select name, term, p from grams where p >= 0.3 and not label order by {_unit(chr(39) + 'review' + chr(39) + ', name, term')}, name, term limit 2",
    "training_report": "select s.label, g.label as gold, count(*) as examples from gold_seeds s join grams g using (name_id, term_id) group by all",
    "training_summary": """
select (select count(*) from gold_seeds) as examples, (select count(*) from gold) as gold,
  (select count(*) from gold_seeds s join grams g using (name_id, term_id) where g.label) as matches""",
    "run_blocking": "select name_id, name, term_id, term from candidates",
    "run_training_labels": "select name, term, p, said as match, label from run_pairs where label is not null",
    "run_matches": "select name, term, p, match from run_pairs",
    "run_score_eval": "select name, term, match, score_eval from run_judged",
    "run_names": """
select name_id, name, cast(to_json(tokens) as varchar) as tokens, cast(to_json(list(text order by i)) as varchar) as derived
from names join derived using (name_id) group by name_id, name, tokens""",
    "run_manifest": """
select 'blocking' as name, count(*) as rows from candidates union all select 'training_labels', count(*) from gold_seeds
union all select 'matches', count(*) from run_pairs union all select 'score_eval', count(*) from run_judged
union all select 'names', count(*) from (select distinct name_id from derived)""",
    "rewrite_rules": "select token, expansion, round(score, 6) as score, rank from rules",
    "expansion_dictionary": "select name, token, expansion from dictionary",
    "boosted_rerank": """
select name, cast(pos as integer) as pos, expansion, round(score, 6) as score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by name, pos order by round(score, 9) desc, expansion) as rank from boosted) where rank <= 3""",
    "merge_derived": """
with merged as (
  select t.name_id, coalesce(k.text, m.text) as text, m.text is not null and (k.text is null or k.score < t.top) as fresh,
    case when k.text is null then t.top when m.text is null then k.score else greatest(k.score, t.top) end as score,
    k.text is null as added, coalesce(k.i, m.k) as place
  from (select * from kept_strings) k full join made_strings m on k.name_id = m.name_id and k.text = m.text
  join tops t on t.name_id = coalesce(k.name_id, m.name_id)),
placed as (
  select *, row_number() over (partition by name_id order by round(score, 9) desc, added, place) as i, bool_or(fresh) over (partition by name_id) as updated
  from merged)
select name_id, updated, cast(i - 1 as integer) as i, text, round(score, 6) as score from placed where i <= 10""",
    "past_examples": f"""
with here as (select * from candidates where {_unit("'now', name_id, term_id")} < 0.5)
select name, term from here union all
select n.name, t.term from gold_seeds s anti join here using (name_id, term_id) join names n using (name_id) join terms t using (term_id)""",
    "refresh_derived": "select name, term, text as derived, true as updated from candidates join derived using (name_id) where i = 0",
    "reuse_features": f"""
select name, term, case when {_unit("'now', name_id, term_id")} < 0.5 then p end as p from candidates join (select name_id, term_id, p from grams) using (name_id, term_id)""",
}


def _with(body: str) -> str:
    """body behind the expressions that it, and they, name."""
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b(from|join)\s+\(*{name}\b|\(select \w+ from {name}\b", sql):
                visit(CTES[name], name)
                needed.append(name)

    visit(body)
    ctes = [f"{name} as materialized ({CTES[name].strip()})" for name in needed]
    body = body.strip()
    if body.startswith("with "):
        body = body[5:] if not ctes else body[5:]
        return "with " + ",\n".join([*ctes, body])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


ORACLE_SQL: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
