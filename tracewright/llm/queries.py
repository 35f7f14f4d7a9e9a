"""The registered queries of the corpus operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, langid, lattice, lines, minhash, mixing, phrases, pii, quality, suffix, tokens
from .common import table



def chat_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls made from every row of conversations: each assistant turn calls a tool with its turn as argument and
    depends on the call two turns before, each other turn answers the call before it; a system message declares the tool."""
    own = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    rows = own.select("conv_id", "turn", (F.col("role") == "assistant").alias("asks"))
    name = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    given = F.concat(F.lit('{"tool_calls":[{"id":"'), name(0), F.lit('","name":"'), F.when(F.col("turn") % 5 == 0, "none").otherwise("say"), F.lit('","arguments":{"n":'), F.when(F.col("turn") % 4 == 3, '"x"').otherwise(F.col("turn").cast("string")), F.lit('},"depends_on":["'), name(2), F.lit('"]}]}'))
    answer = F.concat(F.lit('{"tool_call_id":"'), name(1), F.lit('","content":'), F.col("turn").cast("string"), F.lit("}"))
    said = rows.select("conv_id", "turn", F.when(F.col("asks"), "assistant").otherwise("tool").alias("role"), F.when(F.col("asks"), given).otherwise(answer).alias("text"))
    tool = F.lit('{"tools":[{"name":"say","parameters":{"required":["n"],"properties":{"n":{"type":"integer","maximum":4}}}}]}')
    declared = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), tool.alias("text"))
    found = chat.link_calls(said.unionByName(declared))
    return found.select("conv_id", "turn", "id", "level", F.col("result").isNotNull().alias("linked"), F.array_join("errors", ",").alias("errors"))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_near_duplicates": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality.quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_source_mix": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op4_token_files": lambda spark, d: tokens.token_files(table(spark, d, "documents"), added=True),
    "op5_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op6_repeated_strings": lambda spark, d: suffix.remove_repeats(table(spark, d, "documents")),
    "op7_byte_bpe": lambda spark, d: bpe.encode_bpe(table(spark, d, "documents")),
    "op8_chat_format": lambda spark, d: chat.format_chats(table(spark, d, "conversations")),
    "op9_personal_data": lambda spark, d: pii.find_pii(table(spark, d, "documents")),
    "op10_near_vectors": lambda spark, d: lattice.link_vectors(table(spark, d, "embeddings")),
    "op11_source_divergence": lambda spark, d: divergence.audit(table(spark, d, "documents")),
    "op12_collocations": lambda spark, d: phrases.collocations(table(spark, d, "documents")),
    "op13_line_dedup": lambda spark, d: lines.line_report(table(spark, d, "documents")).drop("n_shared"),
    "q_chat_calls": chat_calls,
}

ORACLE: dict[str, str] = {
    "op3_source_mix": r"""
        with recursive sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as bigint) as h
            from documents
        ), sums as (select source, sum(size)::bigint as source_size from sized group by source),
        weighed as (
            select source, source_size, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from sums
        ), whole as (select sum(source_size)::double as total, sum(w) as weights from weighed),
        rates as (
            select 0 as step, 1.5 * total / weights as rate from whole
            union all
            select step + 1, (select (1.5 * any_value(total) - coalesce(sum(case when 2.0 * source_size <= r.rate * w then 2.0 * source_size end), 0))
                / coalesce(sum(case when 2.0 * source_size > r.rate * w then w end), any_value(weights)) from weighed, whole)
            from rates r where step < 60
        ), aims as (
            select source, source_size, least(2.0 * source_size, (select arg_max(rate, step) from rates) * w) as target from weighed
        ), run as (
            select s.*, a.source_size, a.target, case when a.source_size > 0 then floor(a.target / a.source_size) else 0 end as times,
                sum(size) over (partition by s.source order by h range unbounded preceding)::double as upto,
                sum(size) over (partition by s.source, h)::double as own
            from sized s join aims a on s.source is not distinct from a.source
        )
        select doc_id, size, source_size, target,
            (size * (times + case when upto + upto - own <= 2 * (target - times * source_size) then 1 else 0 end))::bigint as taken
        from run
    """,
    "op8_chat_format": r"""
        select conv_id, turn, role, 0::bigint as n_calls, 0::bigint as n_linked, 0::bigint as n_errors,
            '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null')
            || ',"turn":' || coalesce(turn::varchar, 'null') || '}' as chat_json
        from conversations
    """,
    "op11_source_divergence": r"""
        with docs as (
            select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
        ), words as (select r, lang, source, unnest(terms) as term from docs),
        kept as (select lang, term, count(*) as total from words group by all having count(distinct r) >= 10),
        counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
        groups as (select distinct lang, source from docs),
        grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.total from groups g join kept k using (lang) left join counts c using (lang, source, term)),
        shares as (
            select *, (1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)))::bigint as p,
                (1 + (1000000000::hugeint * (total + 2)) // (sum(total) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)))::bigint as q
            from grid
        ), pairs as (
            select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
            from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), found as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
            union all
            select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from shares where n > 0 and p > q
        ), ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from found)
        select * from ranked where part = 'pair' or rank <= 10
    """,
    "op12_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
        ), cut as (select row_number() over () as p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        words as (select p, lang, unnest(w) as w, unnest(range(len(w))) as i from cut),
        runs as (select lang, w as w1, lead(w) over (partition by p order by i) as w2, lead(w, 2) over (partition by p order by i) as w3 from words),
        f as (
            select lang, [w1] as p, count(*) as n from runs group by all
            union all select lang, [w1, w2], count(*) from runs where w2 is not null group by all
            union all select lang, [w1, w2, w3], count(*) from runs where w3 is not null group by all
        ), often as (select * from f where n >= 10),
        cuts as (select lang, p, n as a, unnest(range(1, len(p))) as k from often where len(p) > 1),
        scored as (
            select c.lang, c.p, c.a, c.k, l.n as l, r.n as r, ((1000000::hugeint * c.a * c.a) // (l.n::hugeint * r.n))::bigint as score
            from cuts c join often l on l.lang = c.lang and l.p = c.p[:c.k] join often r on r.lang = c.lang and r.p = c.p[c.k + 1:]
        ), weakest as (select lang, p, a, unnest(min({'score': score, 'k': k, 'l': l, 'r': r})) from scored group by lang, p, a),
        inside as (select lang, unnest([p[:2], p[2:]]) as p, n from often where len(p) = 3),
        above as (select lang, p, max(n) as n from inside group by lang, p),
        kept as (select w.* from weakest w left join above u on u.lang = w.lang and u.p = w.p where not coalesce(100 * u.n >= 50 * w.a, false)),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank from kept),
        totals as (select lang, count(*) as n from words group by lang)
        select lang, rank::bigint as rank, array_to_string(p, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score
        from ranked join totals using (lang) where rank <= 2000
    """,
    "op13_line_dedup": r"""
        with whole as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, row_number() over () as r from documents),
        cut as (select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from whole),
        keyed as (
            select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from cut
        ), owners as (
            select key, min(coalesce(doc_id, 9223372036854775807)) as owner, max(coalesce(doc_id, 9223372036854775807)) as last
            from keyed where length(key) >= 10 group by key
        )
        select any_value(k.doc_id)::bigint as doc_id, count(*)::bigint as n_lines,
            count(*) filter (where coalesce(owner < coalesce(doc_id, 9223372036854775807), false))::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not coalesce(owner < coalesce(doc_id, 9223372036854775807), false)), '')) as kept_sha256
        from keyed k left join owners o on k.key = o.key group by r
    """,
    "q_chat_calls": r"""
        with a as (select conv_id, turn, row_number() over (partition by conv_id, turn) as copy from conversations where role = 'assistant'),
        f as (select *, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as island from a where copy = 1),
        l as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as level from f),
        r as (select distinct conv_id, turn from conversations where role is distinct from 'assistant')
        select a.conv_id, a.turn, 'c' || a.turn as id, l.level::int as level, r.turn is not null and a.copy = 1 as linked,
            array_to_string(list_filter([case when copy > 1 then 'duplicate_id' end, case when r.turn is null or copy > 1 then 'no_result' end,
                case when a.turn % 5 <> 0 and a.turn % 4 <> 3 and a.turn > 4 then 'out_of_range:n' end, case when a.turn % 5 = 0 then 'unknown_tool' end,
                case when a.turn % 5 <> 0 and a.turn % 4 = 3 then 'wrong_type:n' end], lambda x: x is not null), ',') as errors
        from a join l on l.conv_id = a.conv_id and l.turn = a.turn left join r on r.conv_id = a.conv_id and r.turn = a.turn + 1
    """,
}
