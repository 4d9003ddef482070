"""DuckDB SQL for the registered queries, put together from named subqueries."""

from __future__ import annotations

import re

from sparkquill.operators.evaluate import CUTOFFS, RECALLS
from sparkquill.plans.expected import CLASSES, DELETED, ENTITIES, MONTHS, PREFIXES, STRIPPED
from sparkquill.plans.queries import KEPT_PAIRS, STOP_WORDS
from sparkquill.plans.stemming import stem_table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "(" + ", ".join(map(_lit, xs)) + ")"


def _raw(col: str) -> str:
    return f"list_filter(list_transform(string_split(replace(coalesce({col}, ''), chr(10), ' '), ' '), lambda x: translate(x, {_lit(DELETED)}, '')), lambda x: length(x) > 0)"


def _stripped(col: str) -> str:
    return rf"list_transform({_raw(col)}, lambda x: regexp_replace(translate(lower(x), {_lit(STRIPPED)}, ''), '^\.+|\.+$', '', 'g'))"


def _plain(col: str) -> str:
    return f"list_filter({_stripped(col)}, lambda x: regexp_full_match(x, '[a-z]+'))"


def _marked(col: str, stop: list[str] | None = None) -> str:
    return f"list_transform({_raw(col)}, lambda x: case when regexp_full_match(lower(x), '[a-z]+')" + (f" and lower(x) not in {_list(stop)}" if stop else "") + " then lower(x) end)"


def _phrase_rows(source: str, key: str, col: str, sizes: tuple[int, ...], stop: list[str] | None = None) -> str:
    parts = []
    for n in sizes:
        ok = " and ".join(f"m[i + {k}] is not null" for k in range(n))
        parts.append(f"select {key}, array_to_string(m[i:i + {n - 1}], ' ') as term from (select {key}, {_marked(col, stop)} as m from {source}), unnest(range(1, len(m) - {n - 2})) t(i) where {ok}")
    return " union all ".join(parts)


CASE = "case " + " ".join(f"when regexp_full_match(word, {_lit(p)}) then {_lit(n)}" for n, p, _ in CLASSES) + " else 'other' end"
_NEAR = "list_filter(regexp_split_to_array(translate(translate(lower(text), chr(9), ''), '()', '  '), '[, /|]'), lambda x: length(x) > 0)"

#: Subqueries by name; a query gets those that it names, and those that they name.
PARTS = {
    "tok": f"select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from (select doc_id, {_plain('text')} as w from documents)",
    "post": "select term, doc_id, count(*) as tf from tok group by 1, 2",
    "lex": "select term, count(*) as df, sum(tf)::bigint as ctf from post group by 1",
    "dl": "select doc_id, sum(tf)::bigint as dl, count(*) as n_terms from post group by 1",
    "st": 'select count(*) as "N", coalesce(sum(dl), 0)::bigint as "C", avg(dl) as avgdl, avg(n_terms) as avg_distinct from dl',
    "idf": "select term, df, ctf, log10(N / df) as idf from lex, st",
    "wt": "select doc_id, term, (log10(tf) + 1) * idf as w from post join idf using (term)",
    "nrm": "select doc_id, sum(w * w) as dn from wt group by 1",
    "q": f"select item_id as qid, term, count(*) as qtf from (select item_id, unnest({_plain('text')}) as term from benchmark) group by 1, 2",
    "qw": "select qid, term, (log10(qtf) + 1) * idf as w from q join idf using (term)",
    "more": "select unnest(['$' || o_totalprice::decimal(18,2), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%m/%d/%y'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%b-%d-%Y')]) as w from orders union all select unnest([round(l_discount * 100)::integer || '%', '$' || round(l_extendedprice)::integer || ',000']) from lineitem union all select unnest([replace(c_mktsegment, ' ', '') || '@seg@desk.org', replace(c_mktsegment, ' ', '') || '.desk@shop.com']) from customer union all select unnest([n_name[1:1] || '.' || n_name[2:2] || '.', n_name[1:2] || '.gov', z || '-' || n_nationkey, n_nationkey || '-' || z, n_nationkey || '-' || n_regionkey || '-' || n_regionkey || '-', z || '1.pdf', '§' || n_nationkey || '.' || n_regionkey, 'www.' || z || '1.net', z || '1.x' || n_regionkey]) from (select *, replace(n_name, ' ', '') as z from nation) union all select url from pages",
    "words": rf"select word, count(*) as n from (select unnest({_stripped('text')}) as word from documents union all select regexp_replace(translate(lower(w), {_lit(STRIPPED)}, ''), '^\.+|\.+$', '', 'g') from more) group by 1",
    "ptok": _phrase_rows("documents", "doc_id", "text", (2, 3)),
    "ppost0": "select term, doc_id, count(*) as tf from ptok group by 1, 2",
    "ppost": "select * from ppost0 where term in (select term from ppost0 group by 1 having count(*) >= 5)",
    "plex": "select term, count(*) as df, sum(tf)::bigint as ctf from ppost group by 1",
    "pdl": "select doc_id, sum(tf)::bigint as dl from ppost group by 1",
    "pst": 'select count(*) as "N", avg(dl) as avgdl from pdl',
    "pq": f"select item_id as qid, term, count(*) as qtf from ({_phrase_rows('benchmark', 'item_id', 'text', (2, 3))}) group by 1, 2",
    "pairs": f"select item_id as qid, w[i] as a, w[i + 1] as b, count(*) as qtf from (select item_id, {_NEAR} as w from benchmark), unnest(range(1, len(w))) t(i) group by 1, 2, 3",
    "duo": "select distinct p.a, p.b, x.doc_id from (select distinct a, b from pairs) p join post x on x.term = p.a join post y on y.term = p.b and y.doc_id = x.doc_id",
    "near": "select o.a, o.b, o.doc_id, coalesce(n, 0) as near from duo o left join (select o.a, o.b, o.doc_id, count(*) as n from duo o join tok x on x.doc_id = o.doc_id and x.term = o.a join tok y on y.doc_id = o.doc_id and y.term = o.b where abs(x.pos - y.pos) < 100 group by 1, 2, 3) c on c.a = o.a and c.b = o.b and c.doc_id = o.doc_id",
    "ndf": "select a, b, count(*) as df from near group by 1, 2",
    "s_tfidf": "select qid, doc_id, coalesce(dot / nullif(sqrt(qn) * sqrt(dn), 0), 0.0) as score from (select qid, doc_id, sum(qw.w * wt.w) as dot from qw join wt using (term) group by 1, 2) join (select qid, sum(w * w) as qn from qw group by 1) using (qid) join nrm using (doc_id)",
    "s_bm25": "select qid, doc_id, sum(log10((N - df + 0.5) / (df + 0.5)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * (2.0 * qtf / (1.0 + qtf))) as score from q join lex using (term) join post using (term) join dl using (doc_id), st group by 1, 2",
    "s_phrase": "select qid, doc_id, sum(log10((N - df + 0.5) / (df + 0.5)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * (2.0 * qtf / (1.0 + qtf))) as score from pq join plex using (term) join ppost using (term) join pdl using (doc_id), pst group by 1, 2",
    "s_near": "select qid, doc_id, sum(log10((N - df + 0.5) / (df + 0.5)) * (2.2 * near / (near + 1.2 * (0.25 + 0.75 * dl / avgdl))) * (2.0 * qtf / (1.0 + qtf))) as score from pairs join ndf using (a, b) join near using (a, b) join dl using (doc_id), st group by 1, 2",
    "rel": "select item_id as qid, doc_id, 1::integer as rel from documents d join benchmark b on contains(d.text, b.text) where trim(replace(b.text, chr(10), ' ')) <> ''",
    "r10": "select * from (select *, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rn from s_tfidf) where rn <= 10",
    "fb": "select r.qid, p.term, sum(p.tf) as tf, count(*) as n, any_value(idf) as idf from r10 r join post p using (doc_id) join idf using (term) group by 1, 2",
    "xq": "select qid, term from (select *, row_number() over (partition by qid order by round(tf * idf, 6) desc, term) as rn from fb) where rn <= 10",
    "xw": "select qid, term, idf as w from xq join idf using (term)",
    "s_expand": "select qid, doc_id, coalesce(dot / nullif(sqrt(qn) * sqrt(dn), 0), 0.0) as score from (select qid, doc_id, sum(xw.w * wt.w) as dot from xw join wt using (term) group by 1, 2) join (select qid, sum(w * w) as qn from xw group by 1) using (qid) join nrm using (doc_id)",
    "cen": "select qid, term, sum(coalesce(w / nullif(dn, 0), 0.0)) / any_value(n) as w from r10 join (select qid, count(*) as n from r10 group by 1) using (qid) join wt using (doc_id) join nrm using (doc_id) group by 1, 2",
    "vec0": "select qid, term, coalesce(w / nullif(qn, 0), 0.0) as w from qw join (select qid, sum(w * w) as qn from qw group by 1) using (qid) union all select qid, term, 10 * w from cen c where not exists (select 1 from qw where qw.qid = c.qid and qw.term = c.term)",
    "vec": "select qid, term, w from (select qid, term, round(w, 6) as w, rank() over (partition by qid order by round(w, 6) desc) as rk from vec0) where rk <= 10",
    "s_rocchio": "select qid, doc_id, coalesce(dot / nullif(sqrt(qn) * sqrt(dn), 0), 0.0) as score from (select qid, doc_id, sum(vec.w * wt.w) as dot from vec join wt using (term) group by 1, 2) join (select qid, sum(w * w) as qn from vec group by 1) using (qid) join nrm using (doc_id)",
    "run": "select qid, doc_id, rn - 1 as rank from (select qid, doc_id, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rn from s_bm25) where rn <= 1000",
    "jd": "select r.qid, r.doc_id, r.rank, t.R, case when rel.rel is null then 0 else 1 end as rel, sum(case when rel.rel is null then 0 else 1 end) over (partition by r.qid order by r.rank) as hits from run r join (select qid, count(*) as R from rel group by 1) t on t.qid = r.qid left join rel on rel.qid = r.qid and rel.doc_id = r.doc_id",
    "rall": "select *, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rn, count(*) over (partition by qid) as m from s_tfidf",
    "rlast": "select qid, doc_id from rall where rn - 1 >= m - 10",
    "cenl": "select qid, term, sum(coalesce(w / nullif(dn, 0), 0.0)) / any_value(n) as w from rlast join (select qid, count(*) as n from rlast group by 1) using (qid) join wt using (doc_id) join nrm using (doc_id) group by 1, 2",
    "vecn0": "select qid, term, coalesce(w / nullif(qn, 0), 0.0) as w from qw join (select qid, sum(w * w) as qn from qw group by 1) using (qid) union all select qid, term, sum(w) as w from (select qid, term, 10 * w as w from cen union all select qid, term, -w as w from cenl) c where not exists (select 1 from qw where qw.qid = c.qid and qw.term = c.term) group by 1, 2",
    "vecn": "select qid, term, w from (select qid, term, round(w, 6) as w, rank() over (partition by qid order by round(w, 6) desc) as rk from vecn0) where rk <= 10",
    "near_c": "select o.a, o.b, o.doc_id, coalesce(n, 0) as near from duo o left join (select o.a, o.b, o.doc_id, count(*) as n from duo o join tok x on x.doc_id = o.doc_id and x.term = o.a join tok y on y.doc_id = o.doc_id and y.term = o.b left join tok z on z.doc_id = o.doc_id and z.term = o.a and z.pos = y.pos - 100 where abs(x.pos - y.pos) < 100 and z.pos is null group by 1, 2, 3) c on c.a = o.a and c.b = o.b and c.doc_id = o.doc_id",
    "both_st": 'select pst."N" as "N", st.avgdl as avgdl from pst, st',
    "s_phrase_w": "select qid, doc_id, sum(log10((N - df + 0.5) / (df + 0.5)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * (2.0 * qtf / (1.0 + qtf))) as score from pq join plex using (term) join ppost using (term) join dl using (doc_id), both_st group by 1, 2",
}
_METRICS = [("ap", "sum(hits / (rank + 1) * rel) / any_value(R)"), ("r_precision", "sum(case when rank < R then rel else 0 end) / any_value(R)")]
_METRICS += [(f"p_{k}", f"sum(case when rank < {k} then rel else 0 end) / {k}") for k in CUTOFFS] + [(f"iprec_{r:.1f}", f"coalesce(max(case when hits / R >= {r} - 1e-9 then hits / (rank + 1) end), 0.0)") for r in RECALLS]
PARTS["em"] = " union all ".join(f"select qid, {_lit(n)} as metric, ({v})::double as value from jd group by qid" for n, v in _METRICS)


def _with(sql: str) -> str:
    """The SQL with the parts that it needs before it."""
    need: list[str] = []

    def visit(s: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b(from|join) {name}\b" + (rf"|, {name}\b" if name in ("st", "pst", "both_st", "sst") else ""), s):
                visit(PARTS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    return ("with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in need) + "\n" if need else "") + sql


def _top(scores: str, k: int, tag: str) -> str:
    return _with(f"select qid, doc_id, rn - 1 as rank, score, {_lit(tag)} as tag from (select qid, doc_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rn from {scores}) where rn <= {k}")


def _tokens(names: list[str], tokens: str) -> str:
    return _with(f"select word, token, n from (select word, n, unnest(list_filter({tokens}, lambda t: t <> '')) as token from (select word, n, {CASE} as class from words) where class in {_list(names)})")


_SPLIT = f"list_concat([translate(word, '-.,', '')], list_filter(case when contains(word, '-') then string_split(word, '-') else regexp_extract_all(word, '[a-z]{{3,}}') end, lambda x: length(x) >= 3 and x not in {_list(PREFIXES)}))"
_YEAR = "case when length(word) = 10 then word[7:10]::int when word[7:8]::int >= 69 then 1900 + word[7:8]::int else 2000 + word[7:8]::int end"
_DATE = f"[strftime(try_strptime(({_YEAR}) || '-' || word[1:2] || '-' || word[4:5], '%Y-%m-%d'), '%m/%d/%Y')]"
_MONTHS = "[" + ", ".join(map(_lit, MONTHS)) + "]"
_ABBREVIATED = "[" + ", ".join(_lit(m[:3]) for m in MONTHS) + "]"
_OTHER = "case when regexp_matches(word, '[μ×ñ]') then [word] else list_concat(list_concat(regexp_extract_all(word, '\\$[0-9\\.]+'), regexp_extract_all(word, '[a-z]{3,}')), [regexp_extract(word, '^([a-z]{1,3}/){1,2}[0-9]{0,3}[a-z]{0,3}')]) end"
_EMAIL = "list_transform(range(1, length(word) - length(replace(word, '@', '')) + 1), lambda i: array_to_string(string_split(word, '@')[1:i], '.') || '@' || array_to_string(string_split(word, '@')[i + 1:], '.'))"
_IP = "case when list_bool_and(list_transform(string_split(word, '.'), lambda o: try_cast(o as int) <= 255)) then [word] else list_concat(list_transform(string_split(word, '.'), lambda o: (try_cast(o as int))::varchar), [replace(word, '.', '')]) end"
_DATE3 = f"[case when regexp_full_match(word, '[a-z]{{3}}-[0-9]{{1,2}}-[0-9]{{4}}') then strftime(try_strptime(string_split(word, '-')[3] || '-' || list_position({_ABBREVIATED}, word[1:3]) || '-' || string_split(word, '-')[2], '%Y-%m-%d'), '%m/%d/%Y') end]"
_OF_CLASS = {"date1": _DATE, "date4": _DATE, "date3": _DATE3, "date2": "[]", "ip": _IP, "email": _EMAIL, "paragraph": "[word[1:1], word[2:]]", "other": _OTHER}
_OF_ACTION = {"keep": "[word]", "strip": "[translate(word, ',.', '')]", "split": _SPLIT}
_ALL_TOKENS = "case class " + " ".join(f"when {_lit(n)} then {_OF_CLASS.get(n) or _OF_ACTION[a]}" for n, _, a in [*CLASSES, ("other", "", "")]) + " end"
_AREA, _NUMBER = r"'^\(([0-9]{3})[/\)]'", "([0-9]{3})-([0-9]{4})"


def _full(name: str, source: str, key: str) -> dict[str, str]:
    """Subqueries name_w (words with the two after them) and name (key, i, term): the tokens of the full tokenizer, each word's number with them."""
    clean = r"regexp_replace({}, '^[,.]+|[,.]+$', '', 'g')"
    day, year = clean.format("f"), clean.format("t")
    date = f"case when i < n - 2 and list_position({_MONTHS}, x) > 0 and regexp_full_match({day}, '[0-9]{{1,2}}') and regexp_full_match({year}, '[0-9]{{4}}') then strftime(try_strptime({year} || '-' || list_position({_MONTHS}, x) || '-' || {day}, '%Y-%m-%d'), '%m/%d/%Y') end"
    part = lambda x, k: f"regexp_extract({x}, '{_NUMBER}', {k})"
    area = f"regexp_extract(x, {_AREA}, 1)"
    phone = f"case when i = n or {area} = '' then null when regexp_matches(x, '{_NUMBER}') then [{area}, {part('x', 1)}, {part('x', 2)}, {area} || {part('x', 1)} || {part('x', 2)}] when regexp_matches(f, '^{_NUMBER}') then [{area}, {area} || {part('f', 1)} || {part('f', 2)}] end"
    strip = rf"regexp_replace(translate(x, {_lit(STRIPPED)}, ''), '^\.+|\.+$', '', 'g')"
    return {
        f"{name}_w": f"select {key}, i, len(w) as n, w[i] as x, w[i + 1] as f, w[i + 2] as t, regexp_replace(translate(w[i], {_lit(STRIPPED)}, ''), '^\\.+|\\.+$', '', 'g') as word from (select {key}, list_transform({_raw('text')}, lambda x: lower(x)) as w from {source}), unnest(range(1, len(w) + 1)) as u(i)".replace("\\\\", "\\"),
        f"{name}_c": f"select word, {_ALL_TOKENS} as tokens from (select word, {CASE} as class from (select distinct word from {name}_w))",
        f"{name}_t": f"select {key}, i, unnest(case when date is not null then [date] when phone is not null then phone else tokens end) as term from (select {key}, i, word, {date} as date, {phone} as phone from {name}_w) join {name}_c using (word)",
        name: f"select {key}, i, term from {name}_t where term is not null and term <> ''",
    }


PARTS |= _full("full_d", "documents", "doc_id") | _full("full_q", "benchmark", "item_id")
PARTS |= {
    "stems": stem_table(f"select distinct term as word from (select term from full_d union all select term from full_q) where term not in {_list(STOP_WORDS)}"),
    "spost": f"select stem as term, doc_id, count(*) as tf from full_d join stems on word = term group by 1, 2",
    "slex": "select term, count(*) as df, sum(tf)::bigint as ctf from spost group by 1",
    "sdl": "select doc_id, sum(tf)::bigint as dl from spost group by 1",
    "sst": 'select count(*) as "N", avg(dl) as avgdl from sdl',
    "sq": "select item_id as qid, stem as term, count(*) as qtf from full_q join stems on word = term group by 1, 2",
    "s_stem": PARTS["s_bm25"].replace(" q ", " sq ").replace(" lex ", " slex ").replace(" post ", " spost ").replace(" dl using", " sdl using").replace(", st ", ", sst "),
    "pq_s": f"select item_id as qid, term, count(*) as qtf from ({_phrase_rows('benchmark', 'item_id', 'text', (2, 3), STOP_WORDS)}) group by 1, 2",
    "s_phrase3": 'select qid, doc_id, sum(log10((N - df + 0.5) / (df + 0.5)) * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) * (2.0 * qtf / (1.0 + qtf))) as score from pq_s join plex using (term) join ppost using (term) join sdl using (doc_id), pst, (select avgdl as mean from sst) group by 1, 2',
    "s_near3": PARTS["s_near"].replace(" dl using", " sdl using").replace(", st ", ", sst "),
}
_BM25_COMPAT = PARTS["s_bm25"].replace("avgdl", "avg_distinct")
_LM = "select qid, doc_id, bg - ql * ln(dl + 400.0) + found as score from (select qid, doc_id, sum(qtf * (ln(tf + 400.0 * ctf / C) - ln(400.0 * ctf / C))) as found from q join lex using (term) join post using (term), st group by 1, 2) join (select qid, sum(qtf * ln(400.0 * ctf / C)) as bg, sum(qtf) as ql from q join lex using (term), st group by 1) using (qid) join dl using (doc_id)"
_JM = "select qid, doc_id, (bg + found) {} as score from (select qid, doc_id, count(*) as hit, sum(qtf * (log10(0.9 * tf / dl + 0.1 * ctf / C) - log10(0.1 * ctf / C))) as found from q join lex using (term) join post using (term) join dl using (doc_id), st group by 1, 2) join (select qid, sum(qtf * log10(0.1 * ctf / C)) as bg from q join lex using (term), st group by 1) using (qid)"


def _reduced(key: str, qtf: str) -> str:
    return _with(f"select qid, term, {qtf} as qtf from (select *, row_number() over (partition by qid order by {key} desc, term) as rn, count(*) over (partition by qid) as m from q join idf using (term)) where rn <= floor(m * 0.4)")


def _decoded(col: str) -> str:
    for name, value in ENTITIES:
        col = f"replace({col}, {_lit(name)}, {_lit(value)})"
    return col


def _fused(phrase: str = "s_phrase", near: str = "s_near", words: str = "s_bm25", mu: float = 0.4) -> str:
    cut = lambda s, k: f"(select qid, doc_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, doc_id) as rn from {s} qualify rn <= {k})"
    rows = f"(select qid, doc_id, sum(score) as score from (select qid, doc_id, {mu} * score as score from {cut(phrase, 100)} union all select qid, doc_id, sin(0.05) * score from {cut(near, 10)} union all select qid, doc_id, cos(0.05) * score from {cut(words, 100)}) group by 1, 2)"
    return _top(rows, 100, "Positional")


ORACLES: dict[str, str] = {
    "tokens_words": _with("select term, count(*) as n from tok group by 1"),
    "tokens_split_punct": f"select word, count(*) as n from (select unnest({_raw('text')}) as word from documents) group by 1",
    "tokens_money": _tokens(["monetory"], "[translate(word, ',.', '')]"), "tokens_percent": _tokens(["percent"], "[word]"), "tokens_integer": _tokens(["integer"], "[translate(word, ',.', '')]"),
    "tokens_hyphen": _tokens(["hyphen"], _SPLIT), "tokens_dots": _tokens(["dots"], "[word]"), "tokens_dot_notes": _tokens(["dot_notes"], "[translate(word, ',.', '')]"),
    "tokens_email": _tokens(["email"], _EMAIL),
    "tokens_ip": _tokens(["ip"], "case when list_bool_and(list_transform(string_split(word, '.'), lambda o: try_cast(o as int) <= 255)) then [word] else list_concat(list_transform(string_split(word, '.'), lambda o: (try_cast(o as int))::varchar), [replace(word, '.', '')]) end"),
    "tokens_dates": _tokens(["date1", "date4"], _DATE), "tokens_mixes": _tokens(["alpha_digit", "digit_alpha", "digit_alpha_mixes", "no_hyphen_mixes", "alpha_digit_dot"], _SPLIT),
    "tokens_other": _tokens(["other"], "case when regexp_matches(word, '[μ×ñ]') then [word] else list_concat(list_concat(regexp_extract_all(word, '\\$[0-9\\.]+'), regexp_extract_all(word, '[a-z]{3,}')), [regexp_extract(word, '^([a-z]{1,3}/){1,2}[0-9]{0,3}[a-z]{0,3}')]) end"),
    "token_class_histogram": _with(f"select class, sum(n)::bigint as n from (select n, {CASE} as class from words where word <> '') group by 1"),
    "stopword_filter": _with(f"select term, count(*) as n from tok where term not in {_list(STOP_WORDS)} group by 1"),
    "entity_decode": f"select page_id, {_decoded('html')} as decoded from pages",
    "tag_extract": "select page_id, line_no, regexp_extract(line, '<([a-zA-Z]*)>(.*)</[a-zA-Z]*>', 1) as tag, regexp_extract(line, '<([a-zA-Z]*)>(.*)</[a-zA-Z]*>', 2) as value from (select page_id, unnest(l) as line, unnest(range(len(l))) as line_no from (select page_id, string_split(html, chr(10)) as l from pages)) where regexp_extract(line, '<([a-zA-Z]*)>(.*)</[a-zA-Z]*>', 1) <> ''",
    "postings": _with("select term, doc_id, tf from post"),
    "postings_grouped": _with("select term, 0::integer as chunk, string_agg(doc_id || ',' || tf, ',' order by doc_id) as entries from post group by 1"),
    "positions": _with("select term, doc_id, string_agg(pos, ',' order by pos) as positions from tok group by 1, 2"),
    "lexicon": _with("select term, df, ctf from lex"), "lexicon_ids": _with("select row_number() over (order by term) - 1 as term_id, term, df from lex"),
    "doc_lengths": _with("select doc_id, dl, n_terms from dl"),
    "collection_stats": _with('select "N", "C", round(avgdl, 6) as avgdl, round(avg_distinct, 6) as avg_distinct from st'),
    "df_summary": _with("select count(*) as n, max(df) as most, min(df) as least, round(avg(df), 6) as mean, quantile_cont(df, 0.5)::double as median from lex"),
    "df_log2_histogram": _with("select floor(log2(df))::bigint as bucket, count(*) as n from lex group by 1"),
    "forward_index_weights": _with("select doc_id, term, round(w, 6) as w from wt"), "doc_norms": _with("select doc_id, round(dn, 6) as dn from nrm"),
    "query_bag": _with("select term, qid, qtf, df, ctf from q join lex using (term)"),
    "rank_tfidf": _top("s_tfidf", 10, "COSINE"), "rank_bm25": _top("s_bm25", 10, "BM25"), "rank_bm25_compat_avgdl": _top(f"({_BM25_COMPAT})", 10, "BM25"),
    "rank_dirichlet": _top(f"({_LM})", 100, "Dirichlet"), "rank_jm": _top(f"({_JM.format('')})", 10, "JM"), "rank_jm_compat": _top(f"({_JM.format('* hit')})", 10, "JM"),
    "phrases_bigram": f"select term, count(*) as n from ({_phrase_rows('documents', 'doc_id', 'text', (2,))}) group by 1", "phrases_trigram": f"select term, count(*) as n from ({_phrase_rows('documents', 'doc_id', 'text', (3,))}) group by 1",
    "phrase_lexicon_df5": _with("select term, df, ctf from plex"), "rank_phrase_bm25": _top("s_phrase", 10, "BM25"),
    "proximity_pairs": _with("select a as first, b as second, doc_id, near from near"), "rank_proximity": _top("s_near", 30, "positional_index"), "fuse_sin_cos": _fused(),
    "reduce_qtf": _reduced("qtf", "qtf"), "reduce_idf": _reduced("round(idf, 6)", "1::bigint"), "reduce_qtf_idf": _reduced("round(qtf * idf, 6)", "qtf"),
    "expand_tfidf": _with("select qid, term, score, 1::bigint as qtf from (select qid, term, round(tf * idf, 6) as score, row_number() over (partition by qid order by round(tf * idf, 6) desc, term) as rn from fb) where rn <= 10"),
    "expand_dfidf": _with("select qid, term, score, 1::bigint as qtf from (select qid, term, round(n * idf, 6) as score, row_number() over (partition by qid order by round(n * idf, 6) desc, term) as rn from fb) where rn <= 10"),
    "rank_expanded": _top("s_expand", 10, "COSINE"), "rocchio_vector": _with("select qid, term, w from vec"), "rank_rocchio": _top("s_rocchio", 10, "COSINE"),
    "rocchio_negative": _with("select qid, term, w from vecn"), "rank_tfidf_compat_norm": _top("(select qid, doc_id, coalesce(round(score, 6) / nullif(qn, 0), 0.0) as score from s_tfidf join (select qid, sum(w * w) as qn from qw group by 1) using (qid))", 10, "COSINE"),
    "proximity_pairs_compat_window": _with("select a as first, b as second, doc_id, near from near_c"), "rank_phrase_bm25_word_lengths": _top("s_phrase_w", 10, "BM25"),
    "token_full_pipeline": _with("select term, count(*) as n, count(distinct doc_id) as df from full_d group by 1"), "stem_postings": _with("select term, doc_id, tf from spost"), "rank_stem_bm25": _top("s_stem", 10, "BM25"),
    "fuse_three_way": _fused("s_phrase3", "s_near3", "s_stem", 0.0).replace("rn <= 100", "rn <= 100"),
    "qrels": _with("select qid, doc_id, rel from rel"),
    "eval_counts": _with("select count(*) as queries, sum(retrieved)::bigint as retrieved, sum(R)::bigint as relevant, sum(got)::bigint as rel_ret from (select qid, count(*) as retrieved, any_value(R) as R, sum(rel) as got from jd group by 1)"),
    "eval_by_query": _with("select qid, metric, round(value, 6) as value from em"), "eval_means": _with("select case when metric = 'ap' then 'map' else metric end as metric, round(avg(value), 6) as value from em group by 1"),
    "bulk_json": """select doc_id, 0::bigint as line_no, '{"index":{"_id":"' || doc_id || '"}}' as value from documents union all select doc_id, 1, to_json({'doc_name': 'doc-' || doc_id, 'text': text})::varchar from documents""",
}
ORACLES["tokens_seldom"] = _tokens(["date2", "date3", "file", "paragraph", "url", "url2", "url3"], _ALL_TOKENS)
#: Bounds leave out blocks of documents, never a row of the result.
ORACLES |= {f"rank_{k}_bounded": ORACLES[f"rank_{k}"] for k in ("tfidf", "bm25", "dirichlet", "jm")}
#: Nor do pairs that an index keeps.
ORACLES |= {f"{k}_kept": ORACLES[k] for k in ("proximity_pairs", "rank_proximity")}
ORACLES["commonest_pairs"] = _with(f"select a as first, b as second from (select a, b, row_number() over (order by times * least(x.df, y.df) desc, a, b) as rn from (select a, b, sum(qtf) as times from pairs group by 1, 2) join lex x on x.term = a join lex y on y.term = b) where rn <= {KEPT_PAIRS}")
