"""The derived frames as SQL views for the comparison engine."""

from prefboard.functions import fixed, text
from prefboard.sources import derived


def quote(value):
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows):
    def cell(v):
        return str(v) if isinstance(v, int) else quote(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


_SUBSETS = values([(i, *row) for i, row in enumerate(fixed.SUBSETS)])
_LANGUAGES = values([(i, *row) for i, row in enumerate(derived.LANGUAGES)])
_MODELS = values([(i, *row) for i, row in enumerate(derived.MODELS)])
_RUN_MODELS = "[" + ", ".join(quote(m) for m in derived.RUN_MODELS) + "]"

VIEWS = {
    "dim_subsets": f"select * from (values {_SUBSETS}) t(subset_idx, subset, category, weight)",
    "dim_languages": (
        f"select * from (values {_LANGUAGES}) "
        "t(lang_idx, language, doc_lang, language_name, resource_type, family, script)"
    ),
    "pairs": """
select d.doc_id as id, d.doc_id as position, l.language, s.subset,
 substring(d.text, 1, length(d.text) // 3) as prompt,
 case when d.doc_id % 2 = 0 then substring(d.text, length(d.text) // 3 + 1)
  else substring(d.text, length(d.text) // 3 + 1, length(d.text) // 3) end as chosen,
 case when d.doc_id % 3 = 0 then substring(d.text, length(d.text) // 3 + 1)
  else substring(d.text, 2 * (length(d.text) // 3) + 1) end as rejected,
 d.source as chosen_model, concat('alt-', d.source) as rejected_model
from documents d
join dim_languages l on l.doc_lang = d.lang
join dim_subsets s on s.subset_idx = d.doc_id % 23""",
    "bilingual": """
select id, chosen_model as source, language, prompt as input, chosen, rejected,
 'EN: ' || prompt as en_input, 'EN: ' || chosen as en_chosen, 'EN: ' || rejected as en_rejected
from pairs""",
    "judgements": f"""
select g.model, g.model_type, g.language, g.instance_id, s.subset, s.category,
 case when g.h < 6 then 1.0e0 when g.h < 9 then 0.0e0 else 0.5e0 end as result,
 case when g.h < 6 then 2 when g.h < 9 then 0 else 1 end as label
from (select m.model, m.model_type, l.language, d.doc_id as instance_id,
   (d.doc_id*7 + m.model_idx*3 + (d.doc_id % 17)*(l.lang_idx+2) + (d.doc_id % 13)*m.model_idx) % 10 as h
  from documents d
  cross join (values {_MODELS}) m(model_idx, model, model_type)
  cross join dim_languages l
  where not (m.model_idx = 7 and l.lang_idx = 3)) g
join dim_subsets s on s.subset_idx = g.instance_id % 23""",
    "rewards": """
select d.doc_id as id,
 cast((d.doc_id*37 + d.n_chars) % 1000 as double)/100 - 4 as chosen,
 cast((d.doc_id*53 + d.n_chars*3) % 1000 as double)/100 - 5 as rejected
from documents d""",
    "votes": """
select d.doc_id as instance_id, j.judge,
 case (d.doc_id*5 + j.judge*(d.doc_id % 7)) % 5 when 0 then 'A' when 1 then 'A' when 2 then 'B' when 3 then 'B' else 'error' end as vote
from documents d cross join (values (0),(1),(2)) j(judge)""",
    "verdicts": """
select d.doc_id as id,
 case d.doc_id % 6 when 0 then 'Reason. [[A]]' when 1 then 'Reason. [[B]]' when 2 then '[[B]] then [[A]]'
  when 3 then 'Feedback: ok [RESULT] A' when 4 then 'Feedback: ok [RESULT] B ' else 'no verdict' end as judgment
from documents d""",
    "annotations": """
select l.doc_id as id, d.language,
 case when l.doc_id % 11 = 0 then null
  when (l.quality = 1) <> (d.language = 'zho_Hans' and l.doc_id % 4 = 0) then 'A' else 'B' end as human_preference,
 case when l.toxic = 1 then 'toxic' end as notes
from labels l
join (select d.doc_id, l.language from documents d join dim_languages l on l.doc_lang = d.lang
 union all select d.doc_id, 'zho_Hans' from documents d join dim_languages l on l.doc_lang = d.lang) d on d.doc_id = l.doc_id""",
    "done": "select doc_id as id, 'deu_Latn' as target_language from labels",
    "run_models": f"""
select doc_id as id, names[doc_id % {len(derived.RUN_MODELS)} + 1] as model,
 names[(doc_id + 1) % {len(derived.RUN_MODELS)} + 1] as model_2, names[(doc_id + 2) % {len(derived.RUN_MODELS)} + 1] as model_3
from (select doc_id, {_RUN_MODELS} as names from documents)""",
    "multi_turn": """
select conv_id as id, count(*) as n_messages, list(role order by turn) as roles, list(text order by turn) as texts,
 list(text order by turn) filter (role <> 'system') as talk, list(role order by turn) filter (role <> 'system') as speakers
from conversations group by conv_id having arg_max(role, turn) = 'assistant'""",
    # leaderboard steps
    "subset_acc": """
select model, model_type, language, subset, sum(result) as num_correct, count(*) as num_total,
 sum(result) / count(*) as accuracy
from judgements group by all""",
    "category_acc": """
select a.model, a.model_type, a.language, s.category,
 case when count(*) = (select count(*) from dim_subsets x where x.category = s.category)
  then sum(a.accuracy * s.weight) / sum(s.weight) end as score
from subset_acc a join dim_subsets s on s.subset = a.subset
group by a.model, a.model_type, a.language, s.category""",
    "overall_acc": """
select model, model_type, language, case when count(score) = 4 then avg(score) end as score
from category_acc group by model, model_type, language""",
    "long_board": """
select model, model_type, language, 'Overall' as category, score from overall_acc
union all select model, model_type, language, category, score from category_acc""",
    "board": """
select category, model, arg_min(model_type, language) as model_type,
 max(case when language = 'eng_Latn' then score end) as eng_Latn,
 case when count(case when language <> 'eng_Latn' then score end) = 5
  then avg(case when language <> 'eng_Latn' then score end) end as avg_multilingual,
 case when count(case when language <> 'eng_Latn' then score end) = 5
  then stddev_pop(case when language <> 'eng_Latn' then score end) end as std
from long_board group by category, model""",
    "drops": """
select model, (avg_multilingual - eng_Latn) / nullif(eng_Latn, 0) * 100 as drop_pct from board
where category = 'Overall' and avg_multilingual is not null and eng_Latn <> 0""",
    "language_rows": """
select s.*, l.resource_type, l.family, l.script
from (select language, avg(score) * 100 as avg, stddev_samp(score) * 100 as std from overall_acc
 where language <> 'eng_Latn' group by language) s
join dim_languages l on l.language = s.language where l.resource_type is distinct from 'Class-0'""",
    "label_pairs": """
select l.model, l.language, l.instance_id, l.label, e.label as label_eng
from judgements l join judgements e
 on e.model = l.model and e.instance_id = l.instance_id and e.language = 'eng_Latn'
where l.language <> 'eng_Latn'""",
    "kappa": """
select language, instance_id, case when n*n <> chance then (n*agreed - chance)::double / (n*n - chance)::double end as kappa
from (select *, a0*b0 + a1*b1 + a2*b2 as chance from (
 select language, instance_id, count(*) as n, count(*) filter (label = label_eng) as agreed,
  count(*) filter (label = 0) as a0, count(*) filter (label = 1) as a1, count(*) filter (label = 2) as a2,
  count(*) filter (label_eng = 0) as b0, count(*) filter (label_eng = 1) as b1, count(*) filter (label_eng = 2) as b2
 from label_pairs group by language, instance_id))""",
    "model_kappa": """
select model, language, case when n*n <> chance then (n*agreed - chance)::double / (n*n - chance)::double end as kappa
from (select *, a0*b0 + a1*b1 + a2*b2 as chance from (
 select model, language, count(*) as n, count(*) filter (label = label_eng) as agreed,
  count(*) filter (label = 0) as a0, count(*) filter (label = 1) as a1, count(*) filter (label = 2) as a2,
  count(*) filter (label_eng = 0) as b0, count(*) filter (label_eng = 1) as b1, count(*) filter (label_eng = 2) as b2
 from label_pairs group by model, language))""",
    "two_languages": "select * from pairs union all select * replace ('zho_Hans' as language) from pairs",
    "answer_key": """
select p.id, p.language, p.subset, p.chosen as completion_a, p.rejected as completion_b, j.result as scores,
 case when substring(md5('swap:7:' || p.language || ':' || p.id), 1, 1) < '8' then 1 else 0 end as swapped
from two_languages p join judgements j on j.language = p.language and j.instance_id = p.position and j.model = 'org/model-1'""",
    "human": """
select k.*, a.notes, 'A' as gold_preference, case when k.scores = 1 then 'A' else 'B' end as model_preference,
 case when k.swapped = 1 and a.human_preference = 'A' then 'B'
  when k.swapped = 1 and a.human_preference = 'B' then 'A' else a.human_preference end as human_preference
from answer_key k join annotations a on a.id = k.id and a.language = k.language""",
}

NEEDS = {
    "pairs": ["dim_subsets", "dim_languages"],
    "bilingual": ["pairs"],
    "judgements": ["dim_subsets", "dim_languages"],
    "subset_acc": ["judgements"],
    "category_acc": ["subset_acc"],
    "overall_acc": ["category_acc"],
    "long_board": ["overall_acc"],
    "board": ["long_board"],
    "drops": ["board"],
    "language_rows": ["overall_acc"],
    "label_pairs": ["judgements"],
    "kappa": ["label_pairs"],
    "model_kappa": ["label_pairs"],
    "two_languages": ["pairs"],
    "annotations": ["dim_languages"],
    "answer_key": ["two_languages", "judgements"],
    "human": ["answer_key", "annotations"],
}


def using(views, body):
    """`body` behind a WITH clause that defines the named views and what they need."""
    ordered = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views.split():
        add(view)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} as materialized ({VIEWS[name].strip()})" for name in ordered)
    return f"with {ctes}\n{body.strip()}"


def sql_sentences(column):
    """List of a text's sentences."""
    for pattern, replacement in text.sentence_marks():
        swapped = replacement.replace("$", "\\")
        column = f"regexp_replace({column}, {quote(pattern)}, {quote(swapped)}, 'g')"
    return f"string_split_regex({column}, {quote(chr(1) + '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 'f]*')})"
