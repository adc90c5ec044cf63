"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

COVER_TREE = """
with recursive v as (
    select row_number() over () k, vec_id, case when len(embedding) > 0
        and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0)) then embedding::double[] end e
    from embeddings
), link as (
    select a.k a, b.k b from v a join v b
    on a.k <> b.k and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
    select k, k r from v union select reach.k, link.b from reach join link on reach.r = link.a
), least as (
    select reach.k, min(v.vec_id) component_id from reach join v on v.k = reach.r group by 1
)
select v.vec_id, coalesce(n.n, 0) n_links, least.component_id, v.vec_id = least.component_id kept
from v join least using (k) left join (select a k, count(*) n from link group by 1) n using (k)
"""

DIVERGENCE = r"""
with d as (
    select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') words
    from documents
), w as (
    select k, lang, source, unnest(words) term from d
), v as (
    select lang, term from w group by all having count(distinct k) >= 10
), g as (
    select distinct lang, source from d
), c as (
    select lang, source, term, count(*) n from w semi join v using (lang, term) group by all
), grid as (
    select g.lang, g.source, v.term, coalesce(c.n, 0)::hugeint n
    from g join v using (lang) left join c using (lang, source, term)
), p as (
    select lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) over s + 2 * count(*) over s) p
    from grid window s as (partition by lang, source)
), whole as (
    select lang, term, sum(n)::hugeint n from grid group by all
), q as (
    select lang, term, 1 + 1000000000 * (n + 2) // (sum(n) over s + 2 * count(*) over s) q
    from whole window s as (partition by lang)
), gap as (
    select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
    select a.lang, a.source, 'pair' part, b.source item, coalesce(gap.value, 0) value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join gap on gap.lang = a.lang and gap.source = a.source and gap.item = b.source
    union all
    select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p join q using (lang, term) where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) r from found
)
select lang, source, part, item, value::bigint "value", r::int "rank" from ranked where part = 'pair' or r <= 10
"""

MIXING = r"""
with z as (
    select row_number() over () k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size
    from documents
), s as (
    select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) no from z group by source
), w as (
    select *, ([5, 2, 1])[(no - 1) % 3 + 1] weight, 3 * source_size cap from s
), f as (
    select *, sum(source_size) over () - sum(cap) over o + cap words_left, sum(weight) over () - sum(weight) over o + weight weight_left
    from w window o as (order by cap * (10 // weight), no)
), j as (
    select *, cap * weight_left <= words_left * weight capped from f
), r as (
    select (select sum(source_size) from j) - coalesce(sum(cap) filter (capped), 0) rest, sum(weight) filter (not capped) share from j
), t as (
    select source, no, source_size, weight, case when capped then cap::double else rest::double * weight::double / share::double end target
    from j, r
), queued as (
    select z.k, z.doc_id, z.size, t.* exclude (source), sum(z.size) over (partition by t.no
        order by md5('13:' || coalesce(z.doc_id::varchar, '')), z.doc_id nulls first, z.size rows unbounded preceding) finish
    from z join t on z.source is not distinct from t.source
), line as (
    select k, size, no, (c.copy * source_size + finish) * (10 // weight) finish
    from queued, (select unnest([0, 1, 2]) copy) c where size > 0
), cut as (
    select k, size, sum(size) over (order by finish, no rows unbounded preceding) so_far from line
), kept as (
    select k, sum(size) taken from cut where so_far <= (select sum(size) from z) group by k
)
select doc_id, size::bigint size, source_size, target, coalesce(taken, 0)::bigint taken from queued left join kept using (k)
"""

ORACLE = {"op10_cover_tree": COVER_TREE, "op11_divergence": DIVERGENCE, "op13_mixing": MIXING}
