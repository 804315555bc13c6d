"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillstone.llm.decontamination import op3_decontamination
from quillstone.llm.media import op4_media
from quillstone.llm.mixing import op9_mixing
from quillstone.llm.ngram_join import op2_ngram_join
from quillstone.llm.pseudonyms import op6_pseudonyms
from quillstone.llm.secrets import op8_secrets
from quillstone.llm.sharding import op1_sharding
from quillstone.llm.substring_dedup import op10_substring_dedup
from quillstone.llm.token_store import op5_token_store
from quillstone.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontamination": op3_decontamination,
    "op4_media": op4_media,
    "op5_token_store": op5_token_store,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
}

WORDS = r"coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []::varchar[])"

#: The exact joins. Seeded draws, trained models, files that are written and read, look-around patterns and tilings are beyond SQL;
#: those queries are held against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": f"""
with recursive t as (select coalesce(text, '') as text, min(doc_id) as rep, count(*) as copies, row_number() over (order by min(doc_id)) as id from documents group by 1),
w as (select id, {WORDS} as w from t),
p as (select id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0),
s as (select distinct id, md5(array_to_string(w[i : i + 4], ' ')) as s from p),
n as (select id, count(*) as n from s group by id),
c as (select a.id as x, b.id as y, count(*) as c from s a join s b on a.s = b.s and a.id < b.id group by 1, 2),
l as (select x, y from c join n u on u.id = c.x join n v on v.id = c.y where c >= 0.8::double * (u.n + v.n - c) - 1e-6),
e as (select x, y from l union all select y, x from l),
r as (select id as x, id as y from t union select r.x, e.y from r join e on e.x = r.y),
k as (select x as id, min(rep) as class_id from r join t on t.id = r.y group by x),
m as (select x as id, count(*) as n_links from e group by x)
select d.doc_id, k.class_id, coalesce(m.n_links, 0) as n_links, t.copies as n_copies
from documents d join t on t.text = coalesce(d.text, '') join k on k.id = t.id left join m on m.id = t.id""",
    "op10_substring_dedup": f"""
with d as (select doc_id, {WORDS} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
h as (select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) as h from p),
c as (select h from h group by h having count(*) > 1),
v as (select distinct doc_id, unnest(range(i, i + 35)) as j from h join c on c.h = h.h),
x as (select doc_id, generate_subscripts(w, 1) as j, unnest(w) as x from d),
k as (select x.doc_id, string_agg(x, ' ' order by x.j) as kept, count(*) as n from x left join v on v.doc_id = x.doc_id and v.j = x.j where v.j is null group by x.doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id""",
}
