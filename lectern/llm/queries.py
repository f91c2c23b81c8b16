"""The queries of this subpackage, and SQL for those that SQL can express at a bearable cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.conversations import op13_conversation_repair
from lectern.llm.fim import op11_fill_in_middle
from lectern.llm.flac import op1_flac_media
from lectern.llm.fmindex import op10_fm_index_decontamination
from lectern.llm.huffman import op9_token_id_output
from lectern.llm.jaccard import op8_ngram_jaccard_join
from lectern.llm.licenses import op7_license_rules
from lectern.llm.minhash import op12_minhash_tensored
from lectern.llm.mixing import op6_hypergeometric_mix
from lectern.llm.quality import op4_crf_quality
from lectern.llm.separators import op3_separator_scan
from lectern.llm.sharding import op2_vector_bin_packing
from lectern.llm.toxicity import op5_toxicity_chain


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_vector_bin_packing": op2_vector_bin_packing,
    "op3_separator_scan": op3_separator_scan,
    "op4_crf_quality": op4_crf_quality,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_hypergeometric_mix": op6_hypergeometric_mix,
    "op7_license_rules": op7_license_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_token_id_output": op9_token_id_output,
    "op10_fm_index_decontamination": op10_fm_index_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash_tensored": op12_minhash_tensored,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op8_ngram_jaccard_join": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_BLANK}') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
        from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id""",
    "op10_fm_index_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') as w from documents),
        i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOW}, '{_ALNUM}') as w from benchmark),
        q as (select distinct item, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w]
              else list_transform(range(1, len(w) - 8), lambda k: w[k:k + 9]) end) as q from i),
        l as (select distinct len(q) as n from q),
        p as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, w from d, l where len(w) >= n),
        h as (select doc_id, pos, n, item from (select doc_id, pos, n, w[pos:pos + n - 1] as g from p) join q on g = q),
        k as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as x from h) group by doc_id),
        t as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from h group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join k using (doc_id) left join t using (doc_id)""",
    "op11_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        r as (select *, len(u) as n, cast('0x' || h[1:8] as ubigint) as a, cast('0x' || h[9:16] as ubigint) as b, cast('0x' || h[17:24] as ubigint) as c, cast('0x' || h[25:32] as ubigint) as e from d),
        f as (select *, least(a % (n + 1), b % (n + 1))::bigint as lo, greatest(a % (n + 1), b % (n + 1))::bigint as hi,
              case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c % 100 >= 100 then 'plain' when e % 100 < 50 then 'spm' else 'psm' end as form from r),
        p as (select *, array_to_string(u[1:lo], '') as x, array_to_string(u[lo + 1:hi], '') as y, array_to_string(u[hi + 1:], '') as z from f)
        select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p""",
    "op12_minhash_tensored": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_BLANK}') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
        from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id""",
    "op13_conversation_repair": rf"""
        with recursive b as (select list(list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) order by i) as t from range(256) r(i)),
        g as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
        k as (select g.*, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::ubigint), lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::bigint])), 4294967295::ubigint) % 20 as code from g, b),
        m as (select conv_id, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case code when 3 then [0, 1] else [0] end) as copy from k where code > 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as said from m),
        f as (select *, case when not regexp_matches(text, '{_BLANK}') then 'blank' when said > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault, strpos('sua', case when role = '' then '-' else role[1] end) as z from o),
        n as (select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated from f group by 1),
        j as (select a.conv_id, count(*) as illegal from f a join f b on a.conv_id is not distinct from b.conv_id and b.i = a.i + 1 where a.z * 10 + b.z not in (12, 32, 23) group by 1),
        v as (select conv_id, 0::bigint as i, 0 as s, {{'c': 0, 'a': '', 't': []::varchar[]}} as v from n union all
          select conv_id, i, s, min(v) from (
            select conv_id, i + 1 as i, case e when 'D' then s when 'K' then (case z when 1 then 1 else nx end) else nx end as s,
              {{'c': v.c + (case e when 'D' then 2 when 'R' then 1 else 0 end) + (case when e <> 'D' and fault = 'truncated' then 5 else 0 end), 'a': v.a || e,
                't': case e when 'D' then v.t when 'K' then list_append(v.t, role || ':' || text) else list_append(v.t, (case nx when 2 then 'user:' else 'assistant:' end) || text) end}} as v
            from (select y.conv_id, y.i, y.s, y.v, case y.s when 2 then 3 else 2 end as nx, f.role, f.text, f.fault, f.z, unnest(['D', 'K', 'R']) as e from (
                select conv_id, i, case when k = 0 then s when (k = 1) = (s = 2) then 3 else 2 end as s,
                  {{'c': v.c + 5 * k, 'a': v.a || repeat('I', k), 't': v.t || (case k when 0 then []::varchar[] when 1 then [case s when 2 then 'assistant:' else 'user:' end] else (case s when 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end) end)}} as v
                from (select conv_id, i, s, v, unnest([0, 1, 2]) as k from v)) y join f on f.conv_id is not distinct from y.conv_id and f.i = y.i + 1)
            where e = 'D' or (fault not in ('blank', 'duplicate') and (e = 'R' or (z = 1 and s = 0) or (z > 1 and z = nx)))) group by 1, 2, 3),
        w as (select conv_id, min({{'c': v.c + 5 * k, 'a': v.a || repeat('I', k), 't': v.t || (case k when 0 then []::varchar[] when 1 then ['assistant:'] else ['user:', 'assistant:'] end)}}) as v
          from (select v.*, case s when 1 then 2 when 2 then 1 else 0 end as k from v join n on n.conv_id is not distinct from v.conv_id and n.n = v.i) group by 1)
        select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(w.v.c, 0) as cost,
          coalesce(w.v.a, '') as audit, sha256(coalesce(array_to_string(w.v.t, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) d left join n on n.conv_id is not distinct from d.conv_id left join j on j.conv_id is not distinct from d.conv_id left join w on w.conv_id is not distinct from d.conv_id""",
}
