"""Queries of the corpus operators for the registry."""

from __future__ import annotations

from .byte_dedup import op2_byte_dedup
from .collocations import op12_collocations
from .decontaminate import op5_decontaminate
from .html_text import op7_html_text
from .lm import op3_lm_score
from .merkle import op13_merkle
from .quality import op1_quality
from .secrets import op4_secret_scan
from .sentencepiece import op9_sentencepiece
from .simhash import op10_simhash
from .toxicity import op11_toxicity
from .vectors import op6_nearest
from .word_dedup import op8_word_dedup

QUERIES = {
    "op1_quality": op1_quality,
    "op2_byte_dedup": op2_byte_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_nearest": op6_nearest,
    "op7_html_text": op7_html_text,
    "op8_word_dedup": op8_word_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}

#: CRC-32 of a column's decimal text, byte by byte over a table made from its polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": f"""
        with b as (select item_id, {_BENCH_WORDS} as w from benchmark),
        bs as (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0),
        bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from bs),
        d as (select doc_id, {_BENCH_WORDS} as w from documents),
        ds as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n),
        dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from ds),
        occ as (select doc_id, i, n, item_id from dw join bw using (n, s)),
        p as (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from occ)),
        hit as (select doc_id, count(distinct place) as n_hit from p group by doc_id),
        it as (select doc_id, list_sort(list(distinct item_id::varchar)) as items from occ where item_id is not null group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0)::bigint as n_items,
        sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join it using (doc_id)""",
    "op8_word_dedup": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        x as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
        win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from x),
        least_of as (select s, min(doc_id) as first_doc from win group by s),
        hit as (select doc_id, i from win join least_of using (s) where first_doc < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from hit),
        words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
        select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept using (doc_id)""",
    "op12_collocations": f"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
        tot as (select lang, sum(len(w))::bigint as n from w group by lang having sum(len(w)) > 0),
        g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, 5)) as k) where len(w) >= k),
        f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from g group by all having count(*) >= 30),
        many as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
        sub as (select lang, a, k, w, m, unnest(range(1, k - m + 2)) as i from many, (select unnest(range(2, 4)) as m) where m < k),
        inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from sub group by all),
        kept as (select many.* from many left join inside using (lang, phrase) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
        cuts as (select lang, phrase, k, a, w, unnest(range(1, k)) as c from kept),
        scored as (select cuts.*, x.f as l, y.f as r, (2000000 * a::hugeint // (x.f::hugeint + y.f)) as score from cuts
            join f x on x.lang = cuts.lang and x.phrase = array_to_string(w[1:c], ' ')
            join f y on y.lang = cuts.lang and y.phrase = array_to_string(w[c + 1:cuts.k], ' ')),
        worst as (select *, row_number() over (partition by lang, phrase order by score, c) as i from scored),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from worst where i = 1)
        select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join tot using (lang) where rank <= 2000""",
    "op13_merkle": f"""
        with recursive bits as (select i as b, i::bigint as c, 0 as k from (select unnest(range(256)) as i)
            union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
        crc as (select list(c order by b) as crc_table from bits where k = 8),
        d as (select doc_id, lang, n_chars is not null and {_CRC.format("doc_id::varchar")} % 7 = 0 as hit,
            sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) as leaf,
            sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) as other from documents, crc),
        l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from d),
        t as (select lang, 0 as height, place, leaf as h, n from l
            union all select lang, height + 1, place // 2, case when count(*) = 2 then sha256(string_agg(h, '' order by place)) else sha256(min(h)) end, (n + 1) // 2
            from t where n > 1 group by lang, height, place // 2, n),
        subs as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from t where n = 1),
        u as (select 0 as height, place, h, n from subs
            union all select height + 1, place // 2, case when count(*) = 2 then sha256(string_agg(h, '' order by place)) else sha256(min(h)) end, (n + 1) // 2
            from u where n > 1 group by height, place // 2, n),
        allnodes as (select lang, false as up, height, place, h, n from t union all select null, true, height, place, h, n from u),
        climb as (select doc_id, leaf, lang, place as own, false as up, 0 as height, place, n, case when hit then other else leaf end as folded, '' as proof from l
            union all
            select c.doc_id, c.leaf, c.lang, c.own, c.n = 1 or c.up, case when c.n = 1 then 0 else c.height + 1 end, case when c.n = 1 then s.place else c.place // 2 end,
                case when c.n = 1 then s.n else (c.n + 1) // 2 end,
                case when c.n = 1 then c.folded when o.h is null then sha256(c.folded) when c.place % 2 = 0 then sha256(c.folded || o.h) else sha256(o.h || c.folded) end,
                case when c.n = 1 then c.proof else c.proof || coalesce(o.h, '') end
            from climb c join subs s on s.lang is not distinct from c.lang
            left join allnodes o on c.n > 1 and o.up = c.up and (c.up or o.lang is not distinct from c.lang) and o.height = c.height and o.place = xor(c.place, 1)
            where not (c.up and c.n = 1)),
        ends as (select * from climb where up and n = 1)
        select e.doc_id, e.leaf, s.h as subroot, r.h as root, sha256(e.proof) as proof_sha256, e.folded as folded_root, e.folded = r.h as verified
        from ends e join subs s on s.lang is not distinct from e.lang, (select h from u where n = 1) r""",
}
