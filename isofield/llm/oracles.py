"""SQL of another engine for the queries that SQL can express.

The others have none: trained scores (toxicity, quality), tokenizer ids and packing, an approximate search and a block
tree over HTML are held against brute force, round trips or held-out labels in the tests.
"""

from isofield.llm.mixing import SEED
from isofield.plans.registry import random_sql

REACH = """reach as (select a, b from both_ways union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)"""

NGRAM_JOIN = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from w),
 n as (select doc_id, len(s) n from s), e as (select doc_id, unnest(s) g from s),
 c as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
 l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
 both_ways as (select a, b from l union select b, a from l), """ + REACH + """
 select n.doc_id, n.n n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) component_id from n left join reach on reach.a = n.doc_id group by n.doc_id, n.n"""

NEAR_VECTORS = """with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null),
 l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
 both_ways as (select distinct a, b from l), """ + REACH + """,
 k as (select a, count(*) n from both_ways group by 1), m as (select a, min(b) b from reach group by 1)
 select vec_id, coalesce(k.n, 0) n_links, least(vec_id, coalesce(m.b, vec_id)) component_id, vec_id = least(vec_id, coalesce(m.b, vec_id)) kept
 from embeddings left join k on k.a = vec_id left join m on m.a = vec_id"""

WARC = """with p as (select page_id, url, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) hex from pages),
 d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + (i // 4) * 5)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') payload_digest,
  max(page_id) over (partition by hex) top from p)
 select page_id, payload_bytes, payload_digest, case when page_id < top then 'revisit' else 'response' end record_type, case when page_id < top then top end refers_to, url from d"""



def exponion_clusters(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Lloyd's rounds one after the other, over rows of components."""
    near = """a{i} as materialized (select vec_id, (d % 1000)::int c, d // 1000 d from (select vec_id, min(d * 1000 + c) d from (select x.vec_id, c.c, sum((x.v - c.v) * (x.v - c.v))::bigint d
 from x join c{i} c using (i) group by all) group by 1))"""
    move = """m{i} as materialized (select a.c, x.i, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) v from x join a{j} a using (vec_id) group by all),
 c{i} as materialized (select o.c, o.i, coalesce(m.v, o.v)::bigint v from c{j} o left join m{i} m using (c, i))"""
    steps = ["c0 as materialized (select r.c, x.i, x.v from (select vec_id, row_number() over (order by sha256('" + str(seed) + ":' || vec_id)) - 1 c from e) r join x using (vec_id) where r.c < " + str(k) + ")", near.format(i=0)]
    for i in range(1, rounds + 1):
        steps += [move.format(i=i, j=i - 1), near.format(i=i)]
    return """with e as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = 64),
 x as materialized (select vec_id, unnest(range(64)) i, unnest(list_transform(embedding, lambda v: floor(v::double * 1024)::bigint)) v from e), """ + ",\n ".join(steps) + f""",
 h as (select c, sha256(string_agg(v::varchar, ',' order by i)) centroid_sha256 from c{rounds} group by 1)
 select vec_id, a.c as cluster, d distance, sum(d) over (partition by a.c)::bigint cluster_inertia, sum(d) over ()::bigint inertia, centroid_sha256 from a{rounds} a join h using (c)"""


def conversation_repair() -> str:
    """Damage by a table of crc32, then the cheapest edits from the last row on, one step of a recursive query a row."""
    state = lambda c, a, r: f"{{'c': ({c})::bigint, 'a': {a}, 'r': {r}}}"
    kept, to_user, to_assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    reads = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def row(q: int) -> str:
        ways = [state(f"4 + v{q}.c", f"'D' || v{q}.a", f"v{q}.r")]
        for x, to in reads[q].items():
            ways.append(state(f"case when x = '{x}' and f not in (1, 2) then 0 else 1000000 end + case when f = 3 then 3 else 0 end + v{to}.c", f"'K' || v{to}.a", f"{kept} || v{to}.r"))
        to, line = (3, to_assistant) if q == 2 else (2, to_user)
        ways.append(state(f"case when f in (1, 2) then 1000000 when f = 3 then 6 else 3 end + v{to}.c", f"'R' || v{to}.a", f"{line} || v{to}.r"))
        return f"list_min([{', '.join(ways)}]) w{q}"

    def inserted(q: int) -> str:
        u, a = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
        once, twice, one, two = (3, 2, a, a + " || " + u) if q == 2 else (2, 3, u, u + " || " + a)
        return f"list_min([w{q}, {state(f'3 + w{once}.c', f"'I' || w{once}.a", f'{one} || w{once}.r')}, {state(f'6 + w{twice}.c', f"'II' || w{twice}.a", f'{two} || w{twice}.r')}]) v{q}"

    end = ", ".join(f"{state(c, a, r)} v{q}" for q, c, a, r in ((0, "0", "''", "''"), (1, "6", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), (2, "3", "'I'", "chr(10) || 'assistant:'"), (3, "0", "''", "''")))
    return r"""with recursive tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i::bigint)) t),
 d0 as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
 d1 as (select *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ord(c)::bigint), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::bigint), 4294967295) % 20 h from d0, tab),
 d as (select conv_id, turn, case when h = 4 then 'user' else role end role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from d1, (select unnest([0, 1]) copy) where h <> 0 and (copy = 0 or h = 3)),
 r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i, left(role, 1) x from d),
 s as (select *, case when not regexp_matches(text, '[^ 	-
]') then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when not regexp_matches(text, '[.!?][ 	-
]*$') then 3 else 0 end f,
  lag(x) over (partition by conv_id order by i) || x pair from r),
 g as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(f = 1) blank, count_if(f = 2) duplicate, count_if(f = 3) truncated,
  count_if(pair is not null and pair not in ('su', 'ua', 'au')) illegal from s group by 1),
 e as (select conv_id, n + 1 j, """ + end + """ from g union all select conv_id, j, """ + ", ".join(inserted(q) for q in range(4)) + """
  from (select e.conv_id, e.j - 1 j, """ + ", ".join(row(q) for q in range(4)) + """ from e join s on s.conv_id is not distinct from e.conv_id and s.i = e.j - 1))
 select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(v0.c, 0) as cost,
  coalesce(v0.a, '') audit, sha256(substr(coalesce(v0.r, ''), 2)) repaired_sha256
 from (select distinct conv_id from conversations) c left join g on g.conv_id is not distinct from c.conv_id left join (select * from e where j = 1) e on e.conv_id is not distinct from c.conv_id"""


def source_mixing(epochs: int = 3) -> str:
    """Water-filling over sources in order of cap by weight; then each source's documents in the order of their draws."""
    return r"""with t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
 s as (select source, sum(size)::bigint source_size from t group by 1),
 w as (select *, """ + str(epochs) + """::double * source_size cap, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight, sum(source_size) over ()::double total from s),
 f as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) lev from w),
 l as (select lev from f where weight * lev <= cap order by cap / weight, source nulls last limit 1),
 g as (select source, source_size, least(cap, weight * l.lev) target from f, l),
 p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from g),
 d as (select *, """ + random_sql(str(SEED), "size", "coalesce(doc_id, 0)") + """ draw from t),
 o as (select *, sum(size) over (partition by source order by draw, doc_id nulls first, size rows unbounded preceding) upto from d)
 select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target - whole * source_size)::bigint - upto + size)))::bigint taken
 from o join p on p.source is not distinct from o.source"""


SQL = {"op10_source_mixing": source_mixing(), "op12_conversation_repair": conversation_repair(), "op13_exponion_clusters": exponion_clusters(), "op1_ngram_jaccard_join": NGRAM_JOIN, "op3_embedding_near_dedup": NEAR_VECTORS, "op8_warc_round_trip": WARC}
