"""SQL counterparts of the registered queries, for DuckDB on the same tables.

The statements are assembled from shared WITH clauses. They are written from
the operators' rules, independently of the Spark expressions. The derived texts
hold no `_or_` and no irregular headword, so the parsing clauses need only the
general split at the first underscore; the irregular rules have strict tests.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"

# --- shared clauses --------------------------------------------------------

TEXTS = f"""
src_l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) i,
                 unnest(string_split(text, chr(10))) t from documents),
src_w as (select doc_id, i, regexp_extract_all(t, '{WORD}') w from src_l),
src_e as (select doc_id, i, len(w) n,
                 case when starts_with(w[1],'ß') then w[1] else upper(w[1][1])||substr(w[1],2) end h1,
                 case when starts_with(w[2],'ß') then w[2] else upper(w[2][1])||substr(w[2],2) end h2,
                 lower(w[2]) w2, array_to_string(w[3:], ' ') body, array_to_string(w[2:], ' ') rest
          from src_w where len(w) > 0),
src_x as (select doc_id, i, case when n < 3 then h1||', _'||rest||'._' else case i % 5
            when 0 then h1||', _'||h2||' '||body||'._'
            when 1 then h1||', '||w2||', _'||body||'._'
            when 2 then h1||', _idem._ '||h2||' '||body
            when 3 then h1||', _as_ '||h2||', _'||body||'._'
            else '  '||h1||'.  }}'||chr(10)||'  '||h2||'.  }} '||body end end p from src_e),
texts as (select doc_id, 'Front, _ignored._'||chr(10)||chr(10)||'A'||chr(10)||chr(10)
            ||string_agg(p, chr(10)||chr(10) order by i)
            ||chr(10)||chr(10)||'   FINIS.'||chr(10)||'After, _ignored._' as text
          from src_x group by doc_id)"""

LINES = (
    TEXTS
    + """,
ln as (select doc_id, unnest(range(len(s)))::bigint line_no, unnest(s) line
       from (select doc_id, string_split(text, chr(10)) s from texts))"""
)

BODY = (
    LINES
    + """,
seg as (select *,
          min(case when trim(line, ' '||chr(9)||chr(13)) = 'FINIS.' then line_no end)
            over (partition by doc_id) end_at,
          min(case when regexp_full_match(line, '[A-Z]+') then line_no end)
            over (partition by doc_id) head_at,
          (contains(line,' _') or contains(line,',_') or contains(line,'}')
            or starts_with(line,'Fáre a guísa délla') or starts_with(line,'Vliuígn[o]')) is_mark,
          trim(line) = '' blank
        from ln)"""
)

BLOCKS = (
    BODY
    + """,
par as (select *, sum(blank::int) over (partition by doc_id order by line_no) para
        from seg where line_no > head_at and (end_at is null or line_no < end_at)),
fm as (select *, min(case when is_mark then line_no end) over (partition by doc_id, para) first_mark
       from par),
el as (select doc_id, para, line_no, line from fm where not blank and line_no >= first_mark),
bl as (select doc_id, min(line_no) first_line,
         trim(string_agg(case when contains(line,'}') then line||chr(10) else ' '||trim(line) end,
                         '' order by line_no), ' '||chr(10)) block
       from el group by doc_id, para),
blocks as (select doc_id, (row_number() over (partition by doc_id order by first_line) - 1)::int block_no,
                  first_line, block from bl)"""
)

SPLIT = (
    BLOCKS
    + """,
sp as (select doc_id, block_no, block,
         trim(left(block, strpos(block,'_') - 1), ',; ') word_raw,
         trim(substr(block, strpos(block,'_')), ', ') definition
       from blocks where not contains(block,'}') and strpos(block,'_') > 0),
split as (select * from sp where word_raw <> '')"""
)

REFS = (
    SPLIT
    + """,
refd as (select *, list_transform(
           list_filter(list_filter(list_transform(string_split(definition,'_'), lambda x: trim(x)),
                                   lambda x: x <> ''), lambda x, i: i % 2 = 0),
           lambda p: trim(replace(trim(p, ',.'), '&c', ''), ' ,:;.')) refs
         from split)"""
)

RESOLVED = (
    REFS
    + """,
run as (select *, starts_with(definition,'_idem') idem,
          max(case when not starts_with(definition,'_idem') then block_no end)
            over (partition by doc_id order by block_no) base_no from refd),
chain as (select *,
          first_value(definition) over w base_def, first_value(refs) over w base_refs,
          list(word_raw) over (partition by doc_id, base_no order by block_no
                               rows between unbounded preceding and 1 preceding) before
          from run window w as (partition by doc_id, base_no order by block_no)),
resolved as (select doc_id, block_no, word_raw,
          case when not idem then definition
               else replace(replace(replace(definition,'_idem',
                      case when base_no is null then case when before is null then '' else '._' end
                           else base_def end),'__','_'),'._._','._') end definition,
          case when not idem then list_distinct_ordered
               else list_concat(list_reverse(before),
                      case when base_no is null then [null]::varchar[] else base_refs end) end refs
          from (select *, refs list_distinct_ordered from chain))"""
)

GROUPS = """,
gl as (select doc_id, block_no, i, trim(l) l
       from (select doc_id, block_no, unnest(range(len(string_split(block,chr(10))))) i,
                    unnest(string_split(block,chr(10))) l from blocks where contains(block,'}'))
       where trim(l) not in ('','}')),
gd as (select doc_id, block_no,
         string_agg(nullif(trim(case when contains(l,'}') then substr(l, strpos(l,'}')+1) else l end),''),
                    ' ' order by i) d from gl group by doc_id, block_no),
grouped as (select g.doc_id, g.block_no,
              (row_number() over (partition by g.doc_id, g.block_no order by i) - 1)::int part_no,
              split_part(l,'.',1) word,
              case when starts_with(d,'_') then d else '_'||d||'_' end definition
            from gl g join gd using (doc_id, block_no) where not starts_with(l,'}'))"""


def capital(x: str) -> str:
    return (
        f"case when starts_with({x},'u') then 'V'||substr({x},2)"
        f" when starts_with({x},'U') then 'V`'||substr({x},2)"
        f" when starts_with({x},'ß') then {x}"
        f" else upper({x}[1])||substr({x},2) end"
    )


def two_forms(source: str, name: str) -> str:
    """Forms of "word, suffix" headwords of (…, raw) rows, as a clause."""
    return f""",
{name}_t as (select *, split_part(raw, ', ', 1) w, split_part(raw, ', ', 2) v from {source}),
{name}_c as (select *, lower(w) lw, lower(v) lv, lower(v)[1] c, strip_accents(lower(v)[1]) b from {name}_t),
{name}_s as (select *, [c, case when b = 'u' then 'v' when b = 'v' then 'u' else c end,
                 case when b = 'u' and b = c then 'ú' else c end, b] letters from {name}_c),
{name}_p as (select *, list_filter(range(1, length(lw)+1), lambda i: list_contains(letters, lw[i])) hits
             from {name}_s),
{name}_q as (select *, hits[1] s, hits[-1] e,
               list_max(list_filter(range(1, least(length(v), hits[-1]-hits[1])+1),
                                    lambda z: contains(lw, lv[1:z]))) z from {name}_p),
{name}_r as (select *, length(lw) - strpos(reverse(lw), reverse(lv[1:z])) - z + 2 cut from {name}_q),
{name} as (select *, case
     when v = '' then [w]
     when s is null then [{capital('w')}, {capital('v')}]
     when s = e and s = 1 then [w, w[1]||substr(v,2)]
     when s = e then [w, left(w, s-1)||v]
     when z is null then [w]
     when cut = 1 then [w, w[1]||substr(v,2)]
     else [w, left(w, cut-1)||v] end forms from {name}_r)"""


ENTRIES = (
    RESOLVED
    + GROUPS
    + """,
rw as (select *, word_raw raw from resolved)"""
    + two_forms("rw", "fr")
    + """,
entries as (select doc_id, block_no::bigint block_no, 0 part_no, (unnest(range(len(forms))))::int variant_no,
              unnest(forms) word, definition, refs from fr
            union all
            select doc_id, block_no::bigint, part_no, 0, word, definition, []::varchar[] from grouped),
keyed as (select *, regexp_replace(strip_accents(lower(word)),'[^a-z ]','','g') key from entries),
lex as (select *, row_number() over (order by doc_id, block_no, part_no, variant_no) entry_id from keyed)"""
)

WORD_KEYS = f"""
dw as (select unnest(regexp_extract_all(text,'{WORD}')) word from documents),
keys as (select distinct regexp_replace(strip_accents(lower(word)),'[^a-z ]','','g') key from dw
         where regexp_replace(strip_accents(lower(word)),'[^a-z ]','','g') <> '')"""

PART_KEYS = """,
qk as (select distinct regexp_replace(strip_accents(lower(p_name)),'[^a-z ]','','g') q_key from part)"""

LEX_KEYS = """,
keys as (select distinct key from lex where key <> '')"""

TERMS = f""",
ur as (select conv_id, turn, regexp_extract_all(text,'{WORD}') w from conversations where role = 'user'),
ut as (select conv_id||'-'||turn||'-'||unnest(range(len(w))) query_id, unnest(w) term from ur),
uq as (select query_id, regexp_replace(strip_accents(lower(term)),'[^a-z ]','','g') q_key
       from ut where term is not null),
qk as (select distinct q_key from uq where q_key <> '')"""

PAIRS = """,
kg as (select key, '^'||key||'$' p from keys),
kt as (select key, g, count(*) tf from
        (select key, unnest(list_concat(list_transform(range(1,length(p)+1), lambda i: p[i]),
                                        list_transform(range(1,length(p)), lambda i: p[i:i+1]))) g from kg)
       group by key, g),
kn as (select key, sum(tf*tf)::bigint n from kt group by key),
qg as (select q_key, '^'||q_key||'$' p from qk),
qt as (select q_key, g, count(*) tf from
        (select q_key, unnest(list_concat(list_transform(range(1,length(p)+1), lambda i: p[i]),
                                          list_transform(range(1,length(p)), lambda i: p[i:i+1]))) g from qg)
       group by q_key, g),
qn as (select q_key, sum(tf*tf)::bigint n from qt group by q_key),
dot as (select q_key, key, sum(qt.tf*kt.tf)::bigint d from qt join kt using (g) group by q_key, key),
pairs as (select q_key, key, floor(d / sqrt((qn.n*kn.n)::double) * 1e6 + 0.5) / 1e6 score
          from dot join qn using (q_key) join kn using (key))"""


def top_keys(k: int, where: str = "true") -> str:
    return f""",
best as (select * from (select q_key, key, score,
           (row_number() over (partition by q_key order by score desc, key))::int group_rank
         from pairs where {where}) where group_rank <= {k})"""


LEX_SEARCH = "with " + ENTRIES.lstrip() + LEX_KEYS + TERMS + PAIRS
LEX = "with " + ENTRIES.lstrip()
MATCH = "query_id, rank, entry_id, key, word, score"

TOP_ENTRIES = """,
hit as (select * from (select best.*, entry_id, word, definition,
          (row_number() over (partition by q_key order by group_rank, entry_id))::int rank
        from best join lex using (key)) where rank <= {k})"""

BY_WORD = """,
fw as (select key, word, min(entry_id) entry_id from lex where key <> '' group by key, word),
hit as (select * from (select best.*, entry_id, word,
          (row_number() over (partition by q_key order by group_rank, word))::int rank
        from best join fw using (key)) where rank <= 10)"""

CLOSEST = """,
cw as (select key, min(word) word from lex where key <> '' group by key),
near as (select * from (select b.q_key, b.key, b.score, cw.word, l.entry_id, l.definition,
           (row_number() over (partition by b.q_key order by l.entry_id))::int rank
         from best1 b join cw using (key) join lex l on l.key = b.key and l.word = cw.word)
         where rank <= 20)"""

BEST1 = """,
best1 as (select q_key, key, score from (select *, row_number() over (partition by q_key
            order by score desc, key) n from pairs where score {op} 0.75) where n = 1)"""


def add(**statements: str) -> None:
    SQL.update({k: v.strip() for k, v in statements.items()})


# a list of one NULL has no text in DuckDB and the empty text in Spark
REFS_TEXT = "coalesce(array_to_string(refs,'|'),'') refs"

# --- sources and sinks -----------------------------------------------------

add(
    src1_read_lines=f"with {LINES} select line, count(*) n from ln group by line",
    src1_read_texts=f"{LEX} select doc_id, block_no, part_no, variant_no, word, definition from lex",
    src2_lines_from_table="""
select doc_id, unnest(range(len(s)))::bigint line_no, unnest(s) line
from (select doc_id, string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)) s
      from documents)""",
    src3_read_lexicon=f"{LEX} select entry_id, word, definition, {REFS_TEXT}, key from lex",
    snk1_write_lexicon=f"{LEX} select entry_id, word, key from lex",
    snk2_write_key_groups=f"""{LEX},
rk as (select *, row_number() over (partition by key order by entry_id) - 1 rk,
              first_value(word) over (partition by key order by entry_id) fw from lex)
select key, (rk // 10000)::bigint part, nullif(fw[1], '') partition_key, count(*)::int n_entries,
       string_agg(entry_id::varchar, ',' order by entry_id) entries from rk group by all""",
    snk3_json_payload=f"{LEX} select entry_id, word, definition, {REFS_TEXT} from lex",
    snk4_export_by_letter=f"""{LEX}
select nullif(replace(upper(left(strip_accents(lower(replace(replace(word,'[',''),']',''))),1)),'ẞ','ß'),'') letter,
       word, definition, coalesce(array_to_string(refs, chr(10)),'') refs from lex""",
    snk5_upsert_by_id=f"""{LEX}
select entry_id, word, case when starts_with(definition,'_as_') then 'changed '||definition
                            else definition end definition from lex""",
    snk6_index_on_word=f"{LEX} select word, count(*) n from lex group by word",
)

# --- segmentation ----------------------------------------------------------

add(
    seg1_cut_at_end=f"with {BODY} select doc_id, line_no, line from seg where end_at is null or line_no < end_at",
    seg2_skip_to_first_heading=f"with {BODY} select doc_id, line_no, line from seg where line_no > head_at",
    seg3_mark_definition_lines=f"with {BODY} select doc_id, line_no, line, is_mark from seg",
    seg4_entry_lines=f"with {BLOCKS} select doc_id, line_no, line from el",
    seg5_join_block=f"with {BLOCKS} select doc_id, first_line block_no, block from blocks",
    seg6_flush_tail=f"""with {BLOCKS}
select doc_id, arg_max(block, block_no) block, count(*) blocks from blocks group by doc_id""",
)

# --- parsing ---------------------------------------------------------------

LINE_BLOCKS = (
    LINES
    + """,
lb as (select doc_id, line_no block_no, line block, strpos(line,'_') mark_at,
         trim(left(line, strpos(line,'_') - 1), ',; ') w from ln)"""
)

add(
    par1_split_entry=f"with {SPLIT} select doc_id, block_no, word_raw, definition from split",
    par2_clean_headword=f"""
select page_id, replace(replace(replace('<i>'||html||'</i>[er]', '<i>', '['), '</i>', ']'), '[er]', 'er') word
from pages""",
    par3_reject_empty=f"""with {LINE_BLOCKS}
select doc_id, count(*) kept from lb where not contains(block,'}}') and mark_at > 0 and w <> '' group by doc_id""",
    par4_quarantine=f"""with {LINE_BLOCKS}
select doc_id, block_no, case when contains(block,'}}') then 'group_no_definition'
                              when mark_at = 0 then 'no_split' else 'empty_word' end reject_reason
from lb where (contains(block,'}}') and trim(replace(regexp_replace(block,'^.*?[}}]',''),'}}','')) = '')
           or (not contains(block,'}}') and (mark_at = 0 or w = ''))""",
    par5_parse_group=f"with {BLOCKS}{GROUPS} select doc_id, block_no, part_no, word, definition from grouped",
    par6_resolve_idem=f"with {RESOLVED} select doc_id, block_no, word_raw, definition, {REFS_TEXT} from resolved",
    par7_extract_references=f"with {REFS} select doc_id, block_no, {REFS_TEXT} from refd",
    par8_distinct_references=f"""
with t as (select page_id, regexp_extract_all(html, '{WORD}') w from pages)
select page_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') refs from t""",
    par9_expand_variants=f"""with {SPLIT},
rw as (select *, word_raw raw from split){two_forms('rw', 'fr')}
select doc_id, block_no, (unnest(range(len(forms))))::int variant_no, unnest(forms) word from fr""",
    par10_variants=f"""
with t as (select list_transform(regexp_extract_all(text,'{WORD}'), lambda x: lower(x)) w from documents),
n as (select unnest(w[:-2]) a, unnest(w[2:]) b from t where len(w) > 1),
pr as (select distinct case when a[1] = 'ß' then 'ß' else upper(a[1]) end||substr(a,2)||', '||b raw from n){two_forms('pr', 'fv')}
select raw, array_to_string(forms,'|') forms from fv""",
    par11_char_variants="""
with t as (select distinct unnest(string_split(lower(text),'')) c from documents),
l as (select c, strip_accents(c) b from t where regexp_full_match(c,'\\p{L}'))
select c, c || case when b = 'u' then case when b = c then 'vú' else 'v' end
                    when b = 'v' then 'u' else '' end
            || case when b = c then '' else b end letters from l""",
    par12_capitalise=f"""
with w as (select distinct unnest(regexp_extract_all(text,'{WORD}')) word from documents)
select word, {capital('word')} capital from w""",
    par13_parse_lexicon=f"""with {ENTRIES}
select doc_id, block_no, part_no, variant_no, word, definition, {REFS_TEXT} from lex""",
)
SQL["par13_parse_lexicon_lines"] = SQL["par13_parse_lexicon"]

# --- normalisation and markup ----------------------------------------------


def normalised(c: str) -> str:
    return f"""strip_accents({c}) stripped, replace(replace({c},'[',''),']','') printable,
lower(replace(replace(strip_accents({c}),'[',''),']','')) printable_normalised,
regexp_replace(strip_accents(lower({c})),'[^a-z ]','','g') vector_key"""


RUNS = f"""{LEX},
rn as (select doc_id, block_no, part_no, variant_no,
              list_filter(string_split(definition,'_'), lambda x: x <> '') r from lex)"""

add(
    str1_4_normalise_terms=f"""
with w as (select distinct unnest(regexp_extract_all(text,'{WORD}')) word from documents)
select word, {normalised('word')} from w""",
    str1_4_normalise_parts=f"select p_partkey, {normalised('p_name')} from part",
    str5_7_markup_table=f"""{RUNS},
u as (select doc_id, block_no, part_no, variant_no, (unnest(range(len(r))))::int run_no, unnest(r) text from rn)
select *, case when run_no % 2 = 0 then 'italic' else 'roman' end style from u""",
    str6_8_render_definitions=f"""{LEX},
b as (select *, string_split(replace(replace(definition,'[','<em>'),']','</em>'),'_') p from lex)
select doc_id, block_no, part_no, variant_no,
  array_to_string(list_transform(p, lambda x, i:
     case when i = 1 then x when i % 2 = 0 then '<i>'||x else '</i>'||x end), '')
  || case when len(p) % 2 = 0 then '</i>' else '' end html from b""",
    str7_superscripts="""
with m as (select doc_id, regexp_replace(text,'([aeiou]{2})','^\\1','g') t from documents)
select doc_id, array_to_string(regexp_extract_all(t,'\\^([^ ,.]*)',1),'|') superscripts,
       md5(regexp_replace(t,'\\^([^ ,.]*)','<sup>\\1</sup>','g')) tagged_md5 from m""",
    str9_search_term_counts="""
with t as (select regexp_extract(url,'\\?([^#]*)',1) term from pages),
d as (select url_decode(replace(term,'+',' ')) term from t where trim(term) <> '')
select regexp_replace(strip_accents(lower(term)),'[^a-z ]','','g') key, count(*) n from d group by 1""",
)

# --- vectors ---------------------------------------------------------------

GRAMS = f"""with {WORD_KEYS},
kp as (select key, '^'||key||'$' p from keys),
kx as (select key, list_concat(list_transform(range(1,length(p)+1), lambda i: p[i]),
                               list_transform(range(1,length(p)), lambda i: p[i:i+1])) gs from kp),
tf as (select key, gram, count(*) tf from (select key, unnest(gs) gram from kx) group by key, gram),
vocab as (select gram, (row_number() over (order by gram) - 1)::int idx from (select distinct gram from tf))"""

add(
    str10_vector_report=f"""{GRAMS}
select key, '['||string_agg('{{'||idx||': '||tf||'}}', ', ' order by idx)||']' sparse
from tf join vocab using (gram) group by key""",
    vec1_distinct_keys=f"with {WORD_KEYS} select key from keys",
    vec2_char_grams=f"{GRAMS} select key, array_to_string(list_sort(gs),'|') grams from kx",
    vec3_fit_vocabulary=f"{GRAMS} select gram, idx from vocab",
    vec4_term_frequencies=f"""{GRAMS}
select key, gram, tf, (sum(tf*tf) over (partition by key))::bigint norm2 from tf""",
    vec5_dense_vectors=f"""{GRAMS}
select key, (select count(*) from vocab)::int dims, sum(tf)::bigint total, sum(tf*idx)::bigint weighted
from tf join vocab using (gram) group by key""",
    vec6_vector_once_per_key=f"""{LEX}
select doc_id, block_no, part_no, variant_no, key,
       (case when key = '' then 0 else 2*length(key) + 3 end)::bigint total from lex""",
    vec7_model_card=f"""{GRAMS}
select (select count(*) from keys) number_of_vectors, (select count(*) from vocab) vector_size""",
    vec8_sample_nonzero_check=f"""{GRAMS}
select 25::bigint sampled, 25::bigint sampled_nonzero, count(*) vectors, 0::bigint zero_vectors from keys""",
)

# --- search ----------------------------------------------------------------

KEY_SEARCH = f"with {WORD_KEYS}{PART_KEYS}{PAIRS}"

# Pairs of at least 0.75 without a row for every pair: all pairs of whole tables
# take more than 60 GB.
REACHED = """,
ki as (select key, row_number() over () ki, '^'||key||'$' p from keys),
qi as (select q_key, row_number() over () qi, '^'||q_key||'$' p from qk),
ks as (select ki, g, count(*) tf from (select ki, unnest(list_transform(range(1,length(p)+1), lambda i: p[i])) g from ki) group by all),
qs as (select qi, g, count(*) tf from (select qi, unnest(list_transform(range(1,length(p)+1), lambda i: p[i])) g from qi) group by all),
kb as (select ki, g, count(*) tf from (select ki, unnest(list_transform(range(1,length(p)), lambda i: p[i:i+1])) g from ki) group by all),
qb as (select qi, g, count(*) tf from (select qi, unnest(list_transform(range(1,length(p)), lambda i: p[i:i+1])) g from qi) group by all),
kn as (select ki, u, u + b n from (select ki, sum(tf*tf)::bigint u from ks group by ki) join (select ki, sum(tf*tf)::bigint b from kb group by ki) using (ki)),
qn as (select qi, u, u + b n from (select qi, sum(tf*tf)::bigint u from qs group by qi) join (select qi, sum(tf*tf)::bigint b from qb group by qi) using (qi)),
bd as (select qi, ki, sum(qb.tf*kb.tf)::bigint d from qb join kb using (g) group by qi, ki),
-- what single letters can add is bounded by their norms
ca as (select qi, ki, d, qn.n qn, kn.n kn from bd join qn using (qi) join kn using (ki)
       where d + sqrt((qn.u*kn.u)::double) >= 0.749999 * sqrt((qn.n*kn.n)::double)),
-- and may be enough alone
cb as (select qi, ki, 0::bigint d, q.n qn, k.n kn from (select * from qn where u >= 0.5624 * n) q, (select * from kn where u >= 0.5624 * n) k
       where sqrt((q.u*k.u)::double) >= 0.749999 * sqrt((q.n*k.n)::double)),
cc as (select qi, ki, max(d) d, any_value(qn) qn, any_value(kn) kn from (select * from ca union all select * from cb) group by qi, ki),
sd as (select qi, ki, any_value(d) + sum(qs.tf*ks.tf)::bigint d, any_value(qn) qn, any_value(kn) kn
       from cc join qs using (qi) join ks using (ki, g) group by qi, ki),
reached as (select q_key, key, floor(d / sqrt((qn*kn)::double) * 1e6 + 0.5) / 1e6 score from sd join qi using (qi) join ki using (ki)
            where floor(d / sqrt((qn*kn)::double) * 1e6 + 0.5) / 1e6 >= 0.75)"""
TERM_REACH = f"with {WORD_KEYS}{TERMS}{REACHED}"

add(
    sim1_cosine_postings=f"{TERM_REACH} select q_key, key, score from reached",
    sim2_nearest_keys=f"{KEY_SEARCH}{top_keys(10)} select q_key, key, score, group_rank rank from best",
    sim3_find_matches=f"""{LEX_SEARCH}{top_keys(10)}{TOP_ENTRIES.format(k=10)}
select {MATCH} from uq join hit using (q_key)""",
    sim3_find_matches_by_key=f"""{LEX_SEARCH}{top_keys(10)}
select query_id, group_rank rank, entry_id, key, word, score
from uq join best using (q_key) join lex using (key)""",
    sim4_find_by_word=f"""{LEX_SEARCH}{top_keys(10)}{BY_WORD}
select {MATCH} from uq join hit using (q_key)""",
    sim4_find_by_word_by_key=f"""{LEX_SEARCH}{top_keys(10)},
fk as (select key, min(entry_id) entry_id from lex group by key)
select query_id, group_rank rank, entry_id, key, word, score
from uq join best using (q_key) join fk using (key) join (select entry_id, word from lex) using (entry_id)""",
    sim4_find_by_word_nearest=f"""{LEX_SEARCH}{top_keys(20)}{TOP_ENTRIES.format(k=20)},
nw as (select *, row_number() over (partition by q_key, word order by rank) n from hit)
select query_id, (row_number() over (partition by query_id order by rank))::int rank,
       entry_id, key, word, score from uq join (select * from nw where n = 1) using (q_key)""",
    sim5_find_closest=f"""{LEX_SEARCH}{BEST1.format(op='>=')}{CLOSEST}
select {MATCH} from uq join near using (q_key)""",
    sim5_find_closest_by_key=f"""{LEX_SEARCH}{BEST1.format(op='>')}
select query_id, (row_number() over (partition by query_id order by entry_id))::int rank,
       entry_id, key, word, score from uq join best1 using (q_key) join lex using (key)""",
    sim5_find_closest_nearest=f"""{LEX_SEARCH}{top_keys(20, 'score >= 0.75')}{TOP_ENTRIES.format(k=20)}
select {MATCH} from uq join (select *, first_value(word) over (partition by q_key order by rank) fw from hit)
using (q_key) where word = fw""",
    sim6_closest_or_search=f"""{LEX_SEARCH}{BEST1.format(op='>=')}{CLOSEST}{top_keys(10)}{TOP_ENTRIES.format(k=10)}
select {MATCH}, 'exact' route from uq join near using (q_key)
union all
select {MATCH}, 'search' from uq join hit using (q_key) where q_key not in (select q_key from near)""",
    sim7_autocomplete=f"""{LEX_SEARCH}{top_keys(10)}{BY_WORD}
select query_id, string_agg(lower(replace(replace(strip_accents(word),'[',''),']','')), '|' order by rank) suggestions
from uq join hit using (q_key) group by query_id""",
    sim10_compare_results=f"""{TERM_REACH}
select q_key, count(*) hits_a, count(*) hits_b, count(*) hits_both, 1.0::double overlap, 0 max_rank_difference
from reached group by q_key""",
    sim8_link_references=f"""with {ENTRIES.lstrip()}{LEX_KEYS},
rf as (select entry_id, (unnest(range(len(refs))))::int ref_no, unnest(refs) reference from lex),
rt as (select *, lower(replace(replace(strip_accents(reference),'[',''),']','')) term from rf where reference is not null),
rq as (select *, regexp_replace(term,'[^a-z ]','','g') q_key from rt),
qk as (select distinct q_key from rq where q_key <> ''){PAIRS}{BEST1.format(op='>=')}{CLOSEST},
card as (select q_key, max(score) score, min(key) key, arg_min(definition, entry_id) d, count(*) - 1 more
         from near group by q_key),
html as (select *, string_split(replace(replace(d,'[','<em>'),']','</em>'),'_') p from card)
select rq.entry_id, ref_no, reference, term, case when html.key is null then 'search' else 'word' end target,
  html.key, html.score,
  case when html.key is not null then array_to_string(list_transform(p, lambda x, i:
     case when i = 1 then x when i % 2 = 0 then '<i>'||x else '</i>'||x end), '')
  || case when len(p) % 2 = 0 then '</i>' else '' end
  || case when more > 0 then '<br />...and '||more||' more.' else '' end end popover
from rq left join html using (q_key)""",
)
SQL["sim2_nearest_keys_blocked"] = SQL["sim2_nearest_keys"]
SQL["stm1_stream_lookup"] = SQL["sim6_closest_or_search"]

VECTORS = """
with p as (select a.vec_id query_id, b.vec_id, b.label,
  floor(list_cosine_similarity(a.embedding::double[], b.embedding::double[]) * 1e6 + 0.5) / 1e6 score
  from embeddings a cross join embeddings b)"""

add(
    sim12_vector_search=f"""{VECTORS}
select query_id, vec_id, score, rank from (select *, (row_number() over (partition by query_id
  order by score desc, vec_id))::int rank from p) where rank <= 10""",
    sim12_vector_search_by_label=f"""{VECTORS},
g as (select * from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) n
      from p) where n = 1)
select vec_id, query_id, score, label, rank from (select *, (row_number() over (partition by query_id
  order by score desc, vec_id))::int rank from g) where rank <= 5""",
)

# --- reports ---------------------------------------------------------------

CHARS = """
select c as "character", count(*) n from (select unnest(string_split({x},'')) c from lex) where c <> '' group by c"""

add(
    ana1_entry_count=f"{LEX} select count(*) entries from lex",
    ana2_longest=f"""{LEX}
(select length(word)::int length, word value, 'word' what from lex order by 1 desc, entry_id limit 1)
union all
(select length(definition)::int, definition, 'definition' from lex order by 1 desc, entry_id limit 1)""",
    ana3_suspect_variants=f"""
with w as (select unnest(regexp_extract_all(text,'{WORD}')) word from documents)
select word, count(*) n from w where regexp_matches(word,'^\\p{{Ll}}') group by word""",
    ana4_leftover_brackets="""
with l as (select doc_id, unnest(range(len(string_split(text,chr(10)))))::bigint line_no,
                  unnest(string_split(text,chr(10))) line from documents)
select doc_id, line_no from l
where length(replace(line,'[','')) <> length(replace(line,']',''))""",
    ana5_character_inventory=LEX
    + CHARS.format(x="lower(replace(replace(strip_accents(word),'[',''),']',''))"),
    ana6_words_with_unexpected="""
with l as (select doc_id, unnest(range(len(string_split(text,chr(10)))))::bigint line_no,
                  unnest(string_split(text,chr(10))) line from documents)
select doc_id, line_no, c as "character" from l cross join (select unnest(['&',',','-','?']) c) where contains(line, c)""",
    ana7_vector_alphabet=LEX + CHARS.format(x="key"),
    ana8_readiness_check=f"""with {ENTRIES.lstrip()}{LEX_KEYS},
qk as (select unnest(['a','xistone']) q_key){PAIRS}
select (select count(*) from keys) key_groups,
  (select count(distinct q_key) from pairs where score >= 0.75) probes_found,
  (select count(*) from keys) > 1000 and
  (select count(distinct q_key) from pairs where score >= 0.75) = 2 ready""",
    ana9_search_report=f"""with {ENTRIES.lstrip()}{LEX_KEYS},
uq as (select t query_id, regexp_replace(strip_accents(lower(t)),'[^a-z ]','','g') q_key
       from (select unnest(['a','abbellare','Propórre','Cóllerra']) t)),
qk as (select distinct q_key from uq){PAIRS}{BEST1.format(op='>=')}{CLOSEST}{top_keys(10)}{TOP_ENTRIES.format(k=10)}
select query_id, 'top' section, rank, key, word, definition, score from uq join hit using (q_key)
union all select query_id, 'best', rank, key, word, definition, score from uq join near using (q_key)
union all select query_id, 'none', null, null, null, null, null from uq
where q_key not in (select q_key from near)""",
)

# --- versions and streams --------------------------------------------------

add(
    pub1_needs_rebuild=f"{LEX} select 'older' against, true rebuild union all select 'same', false",
    pub2_publish_version=f"{LEX} select entry_id, word, key from lex",
    pub3_lexicon_stats=f"""{LEX}{LEX_KEYS},
gr as (select distinct unnest(list_concat(list_transform(range(1,length(p)+1), lambda i: p[i]),
                                          list_transform(range(1,length(p)), lambda i: p[i:i+1]))) g
       from (select '^'||key||'$' p from keys))
select (select count(*) from lex) entries, (select count(*) from keys) number_of_vectors,
       (select count(*) from gr) vector_size""",
    stm3_quota_report="""
select date_trunc('day', ts)::timestamp window_start, user_id client, count(*) requests,
       greatest(count(*) - 5, 0)::bigint over_limit from events group by 1, 2""",
)
SQL["stm2_stream_ingest"] = SQL["par13_parse_lexicon"]
SQL["stm3_quota_report_stream"] = SQL["stm3_quota_report"]

# --- what is stored, and found again ----------------------------------------

add(
    src1_read_lines_in_order=f"with {LINES} select doc_id, line_no, line from ln",
    par3_rejected_blocks=f"""with {LINES}
select doc_id, line_no block_no, ', _'||line block from ln where line_no % 2 = 1 and not contains(line,'}}')""",
    ana4_leftover_brackets_of_tags="""
select page_id, word, count(*) n
from (select page_id, unnest(string_split(translate(html,'<>','[]'),' ')) word from pages)
where length(replace(word,'[','')) <> length(replace(word,']','')) group by page_id, word""",
    snk2_key_group_vectors=f"""{LEX},
pt as (select distinct key, ((row_number() over (partition by key order by entry_id) - 1) // 10000)::bigint part from lex),
kp as (select distinct key, '^'||key||'$' p from lex where key <> ''),
kt as (select key, g, count(*) tf from
        (select key, unnest(list_concat(list_transform(range(1,length(p)+1), lambda i: p[i]),
                                        list_transform(range(1,length(p)), lambda i: p[i:i+1]))) g from kp)
       group by key, g),
v as (select key, string_agg(g||':'||tf, '|' order by g||':'||tf) vector from kt group by key)
select key, part, coalesce(vector, '') vector from pt left join v using (key)""",
    snk2_search_key_groups=f"""{LEX_SEARCH}{top_keys(10)}
select query_id, group_rank rank, key, score, n_entries from uq join best using (q_key)
join (select key, least(count(*), 10000)::int n_entries from lex group by key) using (key)""",
    sim9_locate_reference_spans=f"""with recursive {ENTRIES.lstrip()},
rn as (select entry_id, refs, list_filter(string_split(definition,'_'), lambda x: x <> '') r from lex where len(refs) > 0),
st(entry_id, refs, r, run_no, n, c, ref_no, hit_run, start) as (
  select entry_id, refs, r, 1, 0, 1, null::int, null::int, null::int from rn
  union all
  select entry_id, refs, r, case when hit > 0 then run_no else run_no + 2 end, case when hit > 0 then n + 1 else n end,
         case when hit > 0 then hit + length(refs[n + 1])::int else 1 end,
         case when hit > 0 then n end, case when hit > 0 then run_no end, case when hit > 0 then hit - 1 end
  from (select *, (case when refs[n + 1] = '' then c
                        when strpos(substr(r[run_no + 1], c), refs[n + 1]) > 0
                        then c - 1 + strpos(substr(r[run_no + 1], c), refs[n + 1]) else 0 end)::int hit
        from st where n < len(refs) and run_no < len(r)))
select entry_id, ref_no, refs[ref_no + 1] reference, hit_run run_no, start from st where ref_no is not null""",
    sim11_graph_recall=f"""{VECTORS}
select count(*) exact_pairs, true enough from (select *, row_number() over (partition by query_id
  order by score desc, vec_id) rank from p) where rank <= 10""",
)
SQL["sim12_pruned_search"] = SQL["sim12_vector_search"]
SQL["sim12_pruned_search_by_label"] = SQL["sim12_vector_search_by_label"]
SQL["stm2_stream_merge"] = SQL["par13_parse_lexicon"]
