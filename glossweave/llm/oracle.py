"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from glossweave.llm.decontamination import WINDOW
from glossweave.llm.line_dedup import MIN_PAGES, RATIO
from glossweave.llm.mixing import BLOCK_DOCS, GOLDEN, HEAVY, MAX_SHARE, PERIOD
from glossweave.llm.quality_rules import RULES, STOP_WORDS

SQL: dict[str, str] = {}

_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with t as (select row_number() over () rid, doc_id, source, string_split(text, chr(10)) ls from {{docs}}),
k as (select rid, source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, {_SPACE})))) line from t),
h as (select source, count(*) pages from t group by source),
b as (select k.source, k.line from k join h on k.source is not distinct from h.source
      where k.line <> '' group by k.source, k.line, h.pages
      having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * h.pages),
g as (select source, list(line) dropped from b group by source),
c as (select t.*, case when dropped is null then ls
        else list_filter(ls, lambda x: not list_contains(dropped, trim(x, {_SPACE}))) end kept
      from t left join g on t.source is not distinct from g.source)
"""

SQL["op2_line_dedup"] = (
    LINE_DEDUP.format(docs="documents")
    + """select doc_id, source, coalesce(len(ls), 0)::bigint n_lines,
    coalesce(len(ls) - len(kept), 0)::bigint n_dropped, array_to_string(kept, chr(10)) as text from c"""
)

_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_MEASURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "stop_word_ratio": "(n_stop_words + 1) / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
}


def _test(rule) -> str:
    top, bottom = _MEASURES[rule.measure].split(" / ")
    value = f"case when {bottom} = 0 then 0.0 else {top}::double / {bottom} end"
    bounds = [f"{value} >= {rule.low}"] * (rule.low > float("-inf"))
    bounds += [f"{value} <= {rule.high}"] * (rule.high < float("inf"))
    return "(" + " and ".join(bounds) + ")"


QUALITY_RULES = f"""
with t as (select row_number() over () rid, doc_id, coalesce(text, '') as text from {{docs}}),
w as (select *, regexp_extract_all(text, '{_WORD}') ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) ls from t),
g as (select rid, unnest(range(1, len(ws) - 3)) i, ws from w where len(ws) >= 5),
f as (select rid, i, array_to_string(ws[i:i+4], ' ') win from g),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) n from f) where n > 1),
v as (select rid, count(distinct i + k) n_repeat from r, (select unnest([0, 1, 2, 3, 4]) k) group by rid),
m as (select doc_id, len(ws)::bigint n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        length(regexp_replace(text, '[^!?]', '', 'g'))::bigint n_marks,
        len(list_filter(ws, lambda x: lower(x) in ({_STOP})))::bigint n_stop_words,
        len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(n_repeat, 0)::bigint n_repeat_words
      from w left join v using (rid)),
q as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
      {", ".join(f"{_test(r)} ok_{r.name}" for r in RULES)} from m)
"""
KEPT = "not base_failed and " + " and ".join(f"ok_{r.name}" for r in RULES)

SQL["op3_quality_rules"] = (
    QUALITY_RULES.format(docs="documents")
    + f"""select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ({KEPT}) kept, {", ".join(f"ok_{r.name}" for r in RULES)} from q"""
)

SQL["op5_url_filter"] = r"""
with u as (select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
r(rhost, rpath, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule,
    max_by(v, length(rhost || rpath)) v
  from u, r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select u.page_id, host, path, m.rule, coalesce(v, 'allow') verdict from u left join m using (page_id)
"""

MIXED = f"""
with recursive n as (select source, count(*) n_docs from {{docs}} group by source),
s as (select source, n_docs, least(n_docs / sum(n_docs) over (), greatest({MAX_SHARE}, 1 / count(*) over ())) x from n),
w as (select source, n_docs, x / sum(x) over () weight from s),
v as (select source, n_docs, weight / sum(weight) over () share,
        ((row_number() over (order by weight desc, source nulls first) - 0.5::double) * {GOLDEN}::double) % 1.0::double golden from w),
u as (select *, case when share >= {HEAVY}::double then 0.5::double else golden end phase, min(n_docs / share) over () reach, row_number() over (order by source nulls first) i from v),
q as (select *, least(ceil(share * reach - 1e-6), n_docs)::bigint quota from u),
m as (select (ceil(ceil(max(reach) / {BLOCK_DOCS}) / {PERIOD}) + 1)::bigint last_p from q),
c as (select * from (select i, p, share, floor(share * (p * {PERIOD}) + phase)::bigint begun,
        floor(share * ((p + 1) * {PERIOD}) + phase)::bigint - floor(share * (p * {PERIOD}) + phase)::bigint n
      from q, (select unnest(range(last_p + 1)) p from m)) where n > 0),
g as (select p, list(i order by i) si, list(n order by i) ns, list(begun order by i) bs, list(share order by i) ws, sum(n)::bigint len from c group by p),
b as (select *, (sum(len) over (order by p) - len)::bigint start from g),
r(p, t, pick, turn, done) as (
  select p, -1, 0, 0::bigint, list_transform(ns, lambda x: 0::bigint) from b
  union all
  select p, t + 1, best, done[best], list_transform(done, lambda x, j: x + case when j = best then 1 else 0 end)
  from (select r.p, t, done, (list_min(list_transform(ns, lambda x, j:
      case when done[j] < x then (case when floor((bs[j] + done[j]) / ws[j]) > start + t + 1 then 1000000000000 else 0 end
        + ceil((bs[j] + done[j] + 1) / ws[j])::bigint) * 100000 + j end)) % 100000)::int best
    from r join b on r.p = b.p where t + 1 < len)),
k as (select doc_id, source, row_number() over (partition by source
      order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first) - 1 n_in_source from {{docs}}),
d as (select k.*, n_in_source // {BLOCK_DOCS} as block, q.i, coalesce(n_in_source < q.quota, false) mixed
      from k left join q on k.source is not distinct from q.source),
x as (select d.doc_id, d.source, n_in_source, block, (b.start + r.t)::bigint slot, mixed
      from d left join c on d.mixed and c.i = d.i and d.block >= c.begun and d.block < c.begun + c.n
      left join b on b.p = c.p
      left join r on r.p = c.p and r.t >= 0 and b.si[r.pick] = d.i and r.turn = d.block - c.begun)
"""

SQL["op6_mix_sources"] = (
    MIXED.format(docs="documents")
    + f"""select doc_id, source, n_in_source, block, slot, slot * {BLOCK_DOCS} + n_in_source % {BLOCK_DOCS} as position,
    mixed from x"""
)

SQL["op11_hard_negatives"] = """
with s as (select vec_id::bigint id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint label,
      embedding from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
v as (select distinct id, label, list_transform(embedding, lambda x: floor(256 * x::double)) x from s),
p as (select a.id anchor_id, a.label a_label, b.id, b.label, list_inner_product(a.x, b.x)::bigint score
      from v a join v b on a.id <> b.id where a.id % 50 = 0),
g as (select anchor_id, id positive_id, score positive_score from p where label = a_label
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select g.*, p.id negative_id, p.score negative_score,
        row_number() over (partition by g.anchor_id, positive_id order by p.score desc, p.id)::int as rank
      from g join p on g.anchor_id = p.anchor_id and label <> a_label
        and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

_ITEM_WORDS = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

CONTAMINATED = f"""
with d as (select row_number() over () rid, doc_id, {_ITEM_WORDS} ws from {{docs}}),
b as (select coalesce(item_id::varchar, '') item, {_ITEM_WORDS} ws from {{items}}),
i as (select item, least(len(ws), {WINDOW}) l, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) s, ws
      from b where len(ws) > 0),
w as (select distinct item, l, array_to_string(ws[s:s + l - 1], ' ') win from i),
ls as (select distinct l from w),
t as (select rid, unnest(range(len(ws))) s, unnest(ws) word from d),
p as (select rid, s, l, string_agg(word, ' ') over (partition by rid, l order by s rows between current row and (l - 1) following) win
      from t, ls),
o as (select rid, s, l, item from p join w using (l, win)),
h as (select rid, count(distinct k) n_hit from (select rid, unnest(range(s, s + l)) k from (select distinct rid, s, l from o)) group by rid),
m as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from o) group by rid),
x as (select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
        sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
      from d left join h using (rid) left join m using (rid))
"""

SQL["op12_decontaminate"] = CONTAMINATED.format(docs="documents", items="benchmark") + "select * from x"

# the remainder of the reflected polynomial, a bit at a time
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''),
    lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""

PREFIX_TRIE = f"""
with t as (select conv_id::bigint conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i
      from {{conversations}} where conv_id is not null),
c as (select conv_id, max(i) n, {_CRC32} % 4 h, conv_id - conv_id % 20 base from t group by conv_id),
u as (select c.conv_id, i, {{{{'role': t.role, 'text': t.text}}}} turn from c join t on t.conv_id = c.base where i <= h
      union all
      select c.conv_id, i + 10, {{{{'role': t.role, 'text': t.text}}}} from c join t on t.conv_id = c.conv_id where i > h),
s as (select conv_id, coalesce(list(turn order by i) filter (turn is not null), []) seq
      from c left join u using (conv_id) group by conv_id),
r as (select conv_id, len(seq) n, unnest(range(len(seq) + 1)) depth, seq from s),
m as (select conv_id, n, depth, seq[1:depth] pre from r),
e as (select pre, depth, min(conv_id) id, count(*) n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) ends_sha256
      from m group by pre, depth),
f as (select e.*, pre[1:depth - 1] up, case when depth = 0 then 0 else
        (n_convs - 1) * len(regexp_extract_all(pre[depth].text, '[^\\x20\\x09-\\x0D]+')) end saves from e),
k as (select up, depth - 1 depth, count(*) n_children from f where depth > 0 group by up, depth),
g as (select f.*, coalesce(n_children, 0) n_children from f left join k on k.up = f.pre and k.depth = f.depth),
z as (select pre, saves, (n_children = 0)::int leaf, unnest(range(depth + 1)) d from g),
y as (select pre[1:d] pre, sum(leaf) n_leaves, sum(saves) saved from z group by pre[1:d]),
x as (select g.id::bigint conv_id, g.depth::bigint as depth, p.id::bigint parent_conv_id, g.n_convs::bigint n_convs,
        g.n_children::bigint n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, g.ends_sha256
      from g join y on y.pre = g.pre left join e p on g.depth > 0 and p.pre = g.up and p.depth = g.depth - 1)
"""

SQL["op13_prefix_trie"] = PREFIX_TRIE.format(conversations="conversations") + "select * from x"
