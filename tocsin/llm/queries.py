"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers

from tocsin.llm import conversation_repair, decontaminate, exact_dedup, html_text, jaccard_join, lexical_search, licenses, lm_score, packing, secrets, sentence_pieces, token_counts, toxicity
from tocsin.llm.common import table

QUERIES = {}
ORACLES = {}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_exact_dedup", f"""
with d as (select doc_id, sha256({_LOW}) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)""")
def op1(spark, d):
    return exact_dedup.report(table(spark, d, "documents"))


@query("op6_decontaminate", f"""
with iw as (select item_id, w, least(13, len(w)) as l from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[s + 1:s + l], ' ') as win
        from (select *, unnest(range(0, len(w) - l + 1)) as s from iw)),
dw as (select doc_id, {_WORDS} as w from documents),
pos as (select doc_id, w, l, unnest(range(0, len(w) - l + 1)) as s from dw, (select distinct l from iw)),
occ as (select p.doc_id, p.s, p.l, win.item_id from pos p join win on win.l = p.l and win.win = array_to_string(p.w[p.s + 1:p.s + p.l], ' ')),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + l)) as p from occ) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items,
                 sha256(array_to_string(list_sort(list(distinct item_id::varchar)), ',')) as sha from occ group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(sha, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join found using (doc_id)""")
def op6(spark, d):
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_jaccard_join", f"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
       else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b using (s) where a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
both_ways as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
least_id as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from least_id left join n using (doc_id)""")
def op9(spark, d):
    return jaccard_join.report(table(spark, d, "documents"))


@query("op7_toxicity")
def op7(spark, d):
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op4_packing")
def op4(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_GRAMS = ", ".join(f"({n}, {t}, '{label}', {base}, '{a} {b} {c}', {g})" for n, t, label, base, a, b, c, g in licenses.template_grams())


@query("op3_licenses", f"""
with w as (select doc_id, {_WORDS} as w from documents),
tpl(template, t, label, base, gram, grams) as (values {_GRAMS}),
g as (select doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as gram from (select *, unnest(range(0, len(w) - 2)) as p from w)),
votes as (select doc_id, template, label, base, grams, p - t as diagonal, list(t) as ts from g join tpl using (gram) group by all),
cut as (select *, case when not base and diagonal - lag(diagonal) over per <= {licenses.GAP} then 0 else 1 end as new
        from votes window per as (partition by doc_id, template order by diagonal)),
numbered as (select *, sum(new) over (partition by doc_id, template order by diagonal rows unbounded preceding) as span from cut),
spans as (select doc_id, template, label, base, grams, span, len(list_distinct(flatten(list(ts)))) as covered, min(diagonal) as start
          from numbered group by all),
marked as (select *, base and covered = grams as is_full, case when base then covered = grams else covered / grams >= {licenses.COVER} end as good from spans)
select w.doc_id, any_value(len(w.w))::bigint as n_words, coalesce(sum(is_full::int), 0)::bigint as n_base,
       min(start) filter (where is_full)::bigint as first_word, max(start) filter (where is_full)::bigint as last_word,
       coalesce(array_to_string(list_sort(list(distinct label) filter (where is_full)), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list(distinct label) filter (where good)), ','), '') as labels,
       coalesce(max(covered / grams) filter (where good), 0.0)::double as score
from w left join marked using (doc_id) group by w.doc_id""")
def op3(spark, d):
    return licenses.report(table(spark, d, "documents"))


@query("op5_secrets")
def op5(spark, d):
    return secrets.report(table(spark, d, "documents"))


@query("op10_token_counts")
def op10(spark, d):
    return token_counts.report(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_html_text")
def op2(spark, d):
    return html_text.report(table(spark, d, "pages"))


@query("op8_lm_score", f"""
with w as (select row_number() over () as uid, doc_id, {_WORDS} as w from documents),
t as (select uid, unnest(w) as word, unnest(range(len(w))) as p from w),
total as (select cast(round(ln(count(*)) * 1e8) as bigint) as l from t),
uni as (select word, cast(round(ln(count(*)) * 1e8) as bigint) as l from t group by word),
big as (select uid, lag(word) over (partition by uid order by p) as a, word as b from t),
own as (select uid, a, b, count(*) as times from big group by all),
pair as (select a, b, sum(times) as n from own where a is not null group by all),
parts as (select own.uid, case when own.a is not null and n = times then times else 0 end as backed,
          times * case when own.a is null then ub.l - total.l when n > times then cast(round(ln(n) * 1e8) as bigint) - ua.l
                  else ub.l - total.l + cast(round(ln({lm_score.BACKOFF}) * 1e8) as bigint) end as part
          from own cross join total join uni ub on ub.word = own.b left join uni ua on ua.word = own.a left join pair on pair.a = own.a and pair.b = own.b)
select any_value(w.doc_id) as doc_id, any_value(len(w.w))::bigint as n_words, coalesce(sum(backed), 0)::bigint as n_backoff,
       round(coalesce(sum(part), 0)::double / 1e8, 6) as score,
       round(sum(part)::double / 1e8 / nullif(any_value(len(w.w)), 0), 6) as mean_score
from w left join parts using (uid) group by w.uid""")
def op8(spark, d):
    return lm_score.report(table(spark, d, "documents"))


@query("op11_sentence_pieces")
def op11(spark, d):
    return sentence_pieces.report(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_TERMS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op12_lexical_search", f"""
with it as (select item_id, unnest({_TERMS}) as t from benchmark),
bag as (select item_id, t, count(*) as times from it group by all),
d as (select doc_id, {_TERMS} as ts from documents),
dn as (select doc_id, len(ts)::bigint as n from d where len(ts) > 0),
stat as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from dn),
tf as (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(ts) as t from d) where t in (select t from bag) group by all),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from (select t, count(*)::bigint as df from tf group by t), stat),
m as (select doc_id, 25 + (75 * n * n_docs) // n_terms as m from dn, stat),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from bag join tf using (t) join w using (t) join m using (doc_id) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from s where score > 0)
select * from r where rank <= {lexical_search.TOP}""")
def op12(spark, d):
    return lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op13_conversation_repair")
def op13(spark, d):
    return conversation_repair.report(table(spark, d, "conversations"))
